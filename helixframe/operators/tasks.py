"""Evaluation tasks: their records, and the rows each trains and evaluates on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import portable as P
from helixframe.operators.corpus import split_form
from helixframe.operators.probes import keep_top_labels
from helixframe.operators.sampling import group_split, random_split, split_strategy, stratified_folds

# Split names that count as validation, and the modes that take all rows of each assay.
VALIDATION_NAMES = ("validation", "valid", "val", "dev", "eval")
ASSAY_MODES = ("proteingym_zeroshot", "proteingym_supervised")
PROBLEMS = ("binary", "multiclass", "multilabel", "regression", "retrieval")


@dataclass(frozen=True)
class Task:
    """One task record; the problem type is checked when it is made."""

    name: str
    dataset: str
    label_col: str
    problem_type: str
    main_metric: str = ""
    train_split: str | None = "train"
    test_split: str | None = "test"
    validation_split: str | None = None
    split_column: str | None = None
    group_by: str | None = None
    auto_split: bool = False
    label_map: dict[str, float] = field(default_factory=dict)
    validation_column_values: tuple[str, ...] = ()
    top_k_labels: int | None = None
    remove_sequence_whitespace: bool = False
    eval_mode: str = "standard"

    def __post_init__(self):
        if self.problem_type not in PROBLEMS:
            raise ValueError(f"unknown problem type {self.problem_type!r} of task {self.name}")


def registry(tasks: DataFrame) -> dict[str, Task]:
    """Task records of a task table, by name (a bounded table)."""
    names = [f for f in Task.__dataclass_fields__ if f in tasks.columns]
    return {r["name"]: Task(**{n: r[n] for n in names if r[n] is not None}) for r in tasks.select(*names).collect()}


def prepare(rows: DataFrame, task: Task, wanted: str, key: str = "row_id", split: str = "split_name", seed: int = 42) -> DataFrame:
    """Rows of a task with ``part`` (train, eval or cv), ``fold`` (only for cv) and the strategy they come from.

    ``rows`` hold the task's dataset; split names compare trimmed and lower-cased. Where a validation split is wanted
    but not there, training rows are dealt to four folds; automatic splits take 80 % of the rows, or of the groups.
    With a split column the rows are told apart by its values instead, and it must give both parts (a test part, or a
    validation part or folds). Assay modes take all training rows, by group; retrieval takes the training rows as
    queries and gallery in one.
    """
    low = lambda x: (x or "").strip().lower()
    mine = rows.where(F.col("dataset") == task.dataset)
    form = split_form(split)
    assays, retrieval = task.eval_mode in ASSAY_MODES, task.problem_type == "retrieval"
    names = [low(task.validation_split)] if task.validation_split else []
    if task.split_column:
        if task.split_column not in rows.columns:
            raise KeyError(f"split column {task.split_column!r} of task {task.name} not found; present: {rows.columns}")
        form = split_form(task.split_column)
        names = [low(v) for v in task.validation_column_values or VALIDATION_NAMES]
    have = bool(names) and not mine.where(form.isin(*names)).limit(1).isEmpty()
    plan = split_strategy(assays, retrieval, bool(task.split_column), wanted, have, task.auto_split, bool(task.test_split))
    none = F.lit(None).cast("int")
    train = mine.where(form == low(task.train_split))
    if plan == "validation_cv4_train":
        out = stratified_folds(train.withColumn("_all", F.lit("x")), "_all", 4, seed, key).withColumn("part", F.lit("cv")).drop("_all")
    elif plan == "test_random_split":
        s = group_split(mine, task.group_by, 0.8, seed, "part") if task.group_by and task.group_by in mine.columns else random_split(mine, 0.8, seed, key, name="part")
        out = s.withColumn("part", F.when(F.col("part") == "test", "eval").otherwise("train")).withColumn("fold", none)
    elif plan in ("proteingym_unchanged", "retrieval_unchanged"):
        out = train.withColumn("part", F.lit("eval")).withColumn("fold", none)
    else:
        wanted_names = names if plan.startswith("validation") else [low(task.test_split)]
        held = mine.where(form.isin(*wanted_names)).withColumn("part", F.lit("eval"))
        if task.split_column and (train.limit(1).isEmpty() or held.limit(1).isEmpty()):
            raise ValueError(f"split column {task.split_column!r} of task {task.name} gives an empty part")
        out = train.withColumn("part", F.lit("train")).unionByName(held).withColumn("fold", none)
    return out.select(F.lit(task.name).alias("task"), key, "part", "fold", F.lit(plan).alias("strategy"))


def labelled(rows: DataFrame, task: Task, seq: str, part: str = "part") -> DataFrame:
    """The columns a task learns from: all of ``rows``, with the sequence and label of the task in their final form.

    Sequences lose their white space where the task says so. Labels go through the task's map (compared as text; what
    is not in it stays), then by problem type: numbers (the first of a list), class texts, or label arrays cut to the
    ``top_k_labels`` most frequent in the training part.
    """
    if task.remove_sequence_whitespace:
        rows = rows.withColumn(seq, P.no_whitespace(seq))
    raw: Column = P.mapped(F.col(task.label_col).cast("string"), {k: str(v) for k, v in task.label_map.items()})
    if task.problem_type == "regression":
        return rows.withColumn(task.label_col, P.number_or_first(raw))
    if task.problem_type != "multilabel":
        return rows.withColumn(task.label_col, P.class_label(raw))
    rows = rows.withColumn(task.label_col, P.multilabel(raw))
    return keep_top_labels(rows, rows.where(F.col(part) == "train"), task.label_col, task.top_k_labels) if task.top_k_labels else rows
