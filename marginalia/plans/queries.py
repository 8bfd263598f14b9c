"""The queries over the given tables. Each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import MissingColumnError
from ..functions import files as path_functions
from ..functions.labels import pair_summary, parse_label_cell
from ..functions.text import EMPTY, NAN, attention_mask, padded, should_skip, strip, tokens
from ..operators import labels as label_ops
from ..operators import metrics as metric_ops
from ..operators import model as nb
from ..operators import quality
from ..operators import selection
from ..operators import summary
from ..operators import triage
from ..operators.external import score_external, predict_external
from ..operators.linear import fit_linear, score_linear
from ..operators.position import chunk_table, with_chunks
from ..operators.profile import issue_codes, profile_rows, status_rollup
from ..operators.split import shuffle_hash, shuffled, split_sizes, with_split
from ..session import fresh_folder, materialise
from ..sinks import models as model_store
from ..sinks import published
from ..sinks import tables as sinks
from ..sources import files as sources
from ..sources.labelled import read_labelled
from ..streaming import arrivals
from ..streaming import classify as streaming
from . import jobs
from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]

MAX_TOKENS = 128
#: The models of the queries drop tokens of a single document.
PRUNED = 2
#: Width of the hashed features of the query that looks at a fit.
LR_FEATURES = 1 << 12
SUMMARY_CATEGORIES = ("unused", "toxic", "quality", "fr", "de")
WIDE_CATEGORIES = ("de", "en", "es", "fr", "quality", "toxic", "unknown")
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.with_skip_reason(t.comments(spark, sf_dir))


def _joined(column: str, separator: str = "|"):
    return F.array_join(F.col(column).cast("array<string>"), separator)


# ---- triage and profiles


@query
def skip_reason_rows(spark, sf_dir):
    triaged = _triaged(spark, sf_dir)
    return triaged.select("doc_id", "skip_reason", should_skip(F.col("skip_reason")).alias("skip"))


@query
def skip_reason_counts(spark, sf_dir):
    return triage.reason_counts(_triaged(spark, sf_dir))


@query
def skip_reason_share_by_file(spark, sf_dir):
    return triage.reason_share(_triaged(spark, sf_dir), "source_file")


@query
def skip_summary_by_file(spark, sf_dir):
    """Skipped rows of a file written as ``reason=count, ...``."""
    counts = triage.reason_counts(_triaged(spark, sf_dir), ["source_file"])
    skipped = counts.filter(should_skip(F.col("skip_reason")))
    pairs = skipped.groupBy("source_file").agg(
        F.collect_list(F.struct("skip_reason", "n")).alias("pairs")
    )
    return pairs.select("source_file", pair_summary(F.col("pairs"), "skip_reason", "n").alias("summary"))


@query
def skip_reason_variant(spark, sf_dir):
    cells = t.mixed_cells(spark, sf_dir)
    parsed = cells.select("event_id", F.parse_json("cell").alias("cell"))
    return triage.with_skip_reason(parsed, "cell").select("event_id", "skip_reason")


@query
def skip_reason_number(spark, sf_dir):
    """A numeric column is not text."""
    events = t.table(spark, sf_dir, "events").select("event_id", "value")
    return triage.with_skip_reason(events, "value", NAN).select("event_id", "skip_reason")


@query
def valid_texts(spark, sf_dir):
    valid = triage.valid_rows(_triaged(spark, sf_dir))
    return valid.select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


@query
def text_functions(spark, sf_dir):
    text = F.concat(F.lit("\u00a0 \t "), F.col("text"), F.lit(" \u2003\n\u0085"))
    stripped = strip(text)
    return t.documents(spark, sf_dir).select(
        "doc_id",
        F.md5(stripped).alias("stripped"),
        F.md5(F.lower(stripped)).alias("lowered"),
        F.length(stripped).cast("bigint").alias("n_chars"),
    )


@query
def file_profile(spark, sf_dir):
    profiles = profile_rows(_triaged(spark, sf_dir))
    return profiles.select(
        "source_file", "status", "total_rows", "empty_rate", "avg_text_length", "max_text_length",
        "n_empty", "n_whitespace", "n_nan", "n_non_text", issue_codes().alias("issues"),
    )


@query
def file_status_rollup(spark, sf_dir):
    return status_rollup(profile_rows(_triaged(spark, sf_dir)))


@query
def strict_input_check(spark, sf_dir):
    return triage.strict_facts(t.comments(spark, sf_dir))


@query
def preview(spark, sf_dir):
    rows = t.documents(spark, sf_dir).select("doc_id", "lang", F.md5("text").alias("text_md5"))
    return sources.preview(rows, "doc_id")


# ---- labels


@query
def parse_labels(spark, sf_dir):
    cells = t.label_cells(spark, sf_dir)
    return cells.select("doc_id", F.array_join(parse_label_cell(F.col("cell")), "~").alias("labels"))


@query
def combine_category_columns(spark, sf_dir):
    docs = t.documents(spark, sf_dir).select(
        "doc_id",
        "text",
        F.col("lang").alias("Category 10"),
        F.when(F.col("n_chars") > 1000, F.concat(F.lit(" "), "source")).otherwise(" ").alias("Category 2"),
        F.when(F.col("lang") != "en", F.lit("\tx ")).alias("Category 1"),
        F.lit("ignored").alias("labels"),
    )
    return label_ops.labelled_table(docs, keep=["doc_id"]).select(
        "doc_id", _joined("labels").alias("labels")
    )


@query
def combine_pattern_columns(spark, sf_dir):
    docs = t.documents(spark, sf_dir).select(
        "doc_id",
        "text",
        F.col("source").alias("label_b"),
        F.when(F.col("n_chars") > 1000, F.lit("long ")).alias("label_a"),
        F.lit("ignored").alias("other"),
    )
    return label_ops.labelled_table(docs, labels_col="label_*", keep=["doc_id"]).select(
        "doc_id", _joined("labels").alias("labels")
    )


@query
def labels_to_wide(spark, sf_dir):
    return label_ops.labels_to_wide(t.labelled(spark, sf_dir).select("doc_id", "labels"))


@query
def widest_label_list(spark, sf_dir):
    return spark.createDataFrame([(label_ops.most_labels(t.labelled(spark, sf_dir)),)], "k BIGINT")


@query
def label_vocabulary(spark, sf_dir):
    names = label_ops.vocabulary_table(t.labelled(spark, sf_dir))
    return names.select(F.col("idx").cast("bigint").alias("idx"), "label")


@query
def multi_hot(spark, sf_dir):
    rows = t.labelled(spark, sf_dir).select("doc_id", "labels")
    coded = label_ops.with_multi_hot(rows, label_ops.vocabulary(rows))
    return coded.select("doc_id", _joined("labels_multi", ",").alias("labels_multi"))


@query
def label_counts(spark, sf_dir):
    return label_ops.ranked_counts(label_ops.label_counts(t.labelled(spark, sf_dir)))


@query
def rare_labels(spark, sf_dir):
    return label_ops.rare_labels(label_ops.label_counts(t.labelled(spark, sf_dir)), 100)


@query
def label_imbalance(spark, sf_dir):
    return label_ops.imbalance(label_ops.label_counts(t.labelled(spark, sf_dir)))


# ---- quality gates


@query
def duplicate_texts(spark, sf_dir):
    return quality.text_facts(t.comments(spark, sf_dir))


@query
def training_gate(spark, sf_dir):
    return quality.training_gate(t.labelled(spark, sf_dir))


@query
def training_gate_verdict(spark, sf_dir):
    """The same gate on texts that hold blanks: one row with the rule that stops it."""
    rows = t.labelled(spark, sf_dir).select("doc_id", "labels")
    return quality.first_failure(
        quality.training_gate(t.comments(spark, sf_dir).join(rows, "doc_id"))
    )


@query
def light_gate(spark, sf_dir):
    return quality.light_gate(t.comments(spark, sf_dir), labels_col="lang")


@query
def training_recommendations(spark, sf_dir):
    return quality.recommendations(t.labelled(spark, sf_dir))


# ---- split, chunks


@query
def split_assign(spark, sf_dir):
    return with_split(t.documents(spark, sf_dir).select("doc_id"), "doc_id")


@query
def sizes_of_split(spark, sf_dir):
    return split_sizes(with_split(t.labelled(spark, sf_dir).select("doc_id"), "doc_id", 0.15, 0.15))


@query
def shuffled_rows(spark, sf_dir):
    rows = shuffled(t.documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    return rows.withColumn("hash", shuffle_hash("doc_id", 42))


@query
def chunk_offsets(spark, sf_dir):
    return chunk_table(t.table(spark, sf_dir, "events"), "event_type")


@query
def chunk_rows(spark, sf_dir):
    events = t.table(spark, sf_dir, "events").select("event_id", "event_type")
    return with_chunks(events, "event_id", "event_type")


# ---- tokens and the count model


@query
def tokenize_truncate(spark, sf_dir):
    """Fixed-length model input: the truncation and padding are the operator."""
    found = tokens(F.col("text"), MAX_TOKENS)
    rows = t.documents(spark, sf_dir).select("doc_id", found.alias("tokens"))
    return rows.select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.array_join(padded(F.col("tokens"), MAX_TOKENS, "_"), " ").alias("tokens"),
        F.array_join(attention_mask(F.col("tokens"), MAX_TOKENS).cast("array<string>"), "").alias("mask"),
    )


def _fit(spark, sf_dir) -> nb.LabelModel:
    return nb.fit(t.labelled(spark, sf_dir), min_documents=PRUNED)


def _long_weights(model: nb.LabelModel) -> DataFrame:
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("label"), F.get("w", F.lit(i)).alias("weight"))
            for i, name in enumerate(model.labels)
        ]
    )
    return model.weights.select("token", "df", F.inline(entries))


@query
def token_label_counts(spark, sf_dir):
    counts = nb.token_counts(t.labelled(spark, sf_dir))
    return counts.select(
        F.coalesce("token", F.lit("(document)")).alias("token"),
        F.coalesce("label", F.lit("(any)")).alias("label"),
        "n",
    )


@query
def nb_weights(spark, sf_dir):
    return _long_weights(_fit(spark, sf_dir))


@query
def nb_bias(spark, sf_dir):
    model = _fit(spark, sf_dir)
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("label"), F.lit(b).cast("bigint").alias("bias"))
            for n, b in zip(model.labels, model.bias)
        ]
    )
    return model.counts.filter("token IS NULL AND label IS NULL").select(F.inline(entries))


@query
def nb_scores(spark, sf_dir):
    model = _fit(spark, sf_dir)
    scored = nb.score(t.comments(spark, sf_dir), model, "doc_id")
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("label"), F.round(F.get("probs", F.lit(i)), 6).alias("prob"))
            for i, name in enumerate(model.labels)
        ]
    )
    return scored.select("doc_id", "skip_reason", F.inline(entries))


@query
def scored_rows(spark, sf_dir):
    """All columns plus one per category, for a table scored without a row key."""
    model = _fit(spark, sf_dir)
    rows = t.comments(spark, sf_dir).select("doc_id", "lang", "text")
    wide = nb.with_category_columns(nb.score_rows(rows, model), model, WIDE_CATEGORIES, 6)
    return wide.drop("text")


@query
def nb_predictions(spark, sf_dir):
    model = _fit(spark, sf_dir)
    scored = nb.score(t.comments(spark, sf_dir), model, "doc_id")
    predicted = nb.with_predictions(scored, model)
    return predicted.select("doc_id", _joined("predicted").alias("predicted"))


@query
def refine_weights(spark, sf_dir):
    """Fit on one half, refine with the other: the weights of a fit on both."""
    parts = materialise(with_split(t.labelled(spark, sf_dir), "doc_id", 0.5, 0.0), "halves")
    first = nb.fit(parts.filter(F.col("split") == "test"), min_documents=PRUNED)
    return _long_weights(nb.refine(first, parts.filter(F.col("split") == "train")))


@query
def test_metrics(spark, sf_dir):
    parts = materialise(with_split(t.labelled(spark, sf_dir), "doc_id", 0.3, 0.0), "parts")
    model = nb.fit(parts.filter(F.col("split") == "train"), min_documents=PRUNED)
    measured = selection.evaluate(model, parts.filter(F.col("split") == "test"), "doc_id")
    return measured.select(*[F.round(c, 6).alias(c) for c in measured.columns])


@query
def label_metrics(spark, sf_dir):
    """Per-label scores of the fit on the table it was fitted on."""
    rows = materialise(t.labelled(spark, sf_dir), "labelled")
    model = nb.fit(rows, min_documents=PRUNED)
    predicted = nb.with_predictions(nb.score_rows(rows, model), model)
    measured = metric_ops.label_metrics(metric_ops.confusion(predicted, model.labels))
    ratios = ("precision", "recall", "f1")
    return measured.select(
        *[F.round(c, 6).alias(c) if c in ratios else c for c in measured.columns]
    )


@query
def early_stop_choice(spark, sf_dir):
    """Trials in order: smoothing, validation micro-F1, whether it improved."""
    parts = materialise(with_split(t.labelled(spark, sf_dir), "doc_id", 0.0, 0.3), "parts")
    training = parts.filter(F.col("split") == "train")
    names = label_ops.vocabulary(parts)
    counts = materialise(nb.token_counts(training, names=names), "counts")
    validation = parts.filter(F.col("split") == "validation")
    _, trials = selection.choose_alpha(counts, validation, "doc_id", names, min_documents=PRUNED)
    rows = [(x.step, x.alpha, round(x.micro_f1, 6), x.improved) for x in trials]
    return spark.createDataFrame(rows, "step BIGINT, alpha DOUBLE, micro_f1 DOUBLE, improved BOOLEAN")


@query
def model_versions(spark, sf_dir):
    """Save a fit, save its refinement, read both versions back."""
    root = fresh_folder(spark, "models")
    rows = materialise(t.labelled(spark, sf_dir), "labelled")
    model_store.save_model(nb.fit(rows, min_documents=PRUNED), root)
    model_store.save_model(nb.refine(model_store.load_model(spark, root), rows), root)
    saved = []
    for version in (1, 2):
        model = model_store.load_model(spark, root, version)
        saved.append(
            model.weights.agg(
                F.lit(version).cast("bigint").alias("version"),
                F.lit("|".join(model.labels)).alias("labels"),
                F.count("*").alias("n_tokens"),
            )
        )
    return saved[0].unionByName(saved[1])


@query
def published_versions(spark, sf_dir):
    """A table published twice; both versions are read after that, by number and as the current one."""
    path = fresh_folder(spark, "published")
    for column in ("source", "lang"):
        rows = t.documents(spark, sf_dir).groupBy(F.col(column).alias("name"))
        published.publish(rows.agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars")), path)
    first, current = published.read_published(spark, path, 1), published.read_published(spark, path)
    number = lambda n: F.lit(n).cast("bigint").alias("version")
    return first.select(number(1), "*").unionByName(current.select(number(2), "*"))


@query
def training_run(spark, sf_dir):
    """Layout, split, fit, selection and test evaluation in one job."""
    run = jobs.train(
        t.labelled(spark, sf_dir), "doc_id", test_size=0.3, valid_size=0.3, gate=False, min_documents=PRUNED
    )
    row = {k: round(v, 6) for k, v in run.metrics.items()}
    fields = ", ".join(f"{name} DOUBLE" for name in row)
    return spark.createDataFrame(
        [(run.model.alpha, *row.values(), *[run.sizes[s] for s in ("train", "validation", "test")])],
        f"alpha DOUBLE, {fields}, n_train BIGINT, n_validation BIGINT, n_test BIGINT",
    )


@query
def lr_scores(spark, sf_dir):
    rows = t.labelled(spark, sf_dir)
    names = label_ops.vocabulary(rows)
    scored = score_linear(t.comments(spark, sf_dir), fit_linear(rows, names), "doc_id", names)
    columns = [F.round(F.get("probs", F.lit(i)), 4).alias(n) for i, n in enumerate(names)]
    return scored.select("doc_id", "skip_reason", *columns)


@query
def lr_balance(spark, sf_dir):
    """Two marks of a regularised fit with a free intercept, per label: the mean fitted probability is the label's
    share of the rows, and the log-loss is below that of the share alone. Necessary, not sufficient, for the optimum."""
    judged = triage.with_skip_reason(t.labelled(spark, sf_dir), null_reason=EMPTY)
    rows = materialise(judged.filter("skip_reason = 'none'").drop("skip_reason"), "labelled")
    names = label_ops.vocabulary(rows)
    models = fit_linear(rows, names, iterations=100, features=LR_FEATURES)
    fitted = score_linear(rows, models, "doc_id", names, features=LR_FEATURES).select("doc_id", "probs")
    hits = rows.select("doc_id", label_ops.multi_hot(F.col("labels"), names).alias("hits"))
    cells = fitted.join(hits, "doc_id").select(F.posexplode(F.arrays_zip("probs", "hits")).alias("idx", "cell")).select("idx", "cell.*")
    share = F.sum(F.col("hits").cast("bigint")) / F.count("*")
    log_loss = -F.avg(F.ln(F.when(F.col("hits") == 1, F.col("probs")).otherwise(1 - F.col("probs"))))
    entropy = -(share * F.ln(share) + (1 - share) * F.ln(1 - share))
    label = F.get(F.array(*[F.lit(name) for name in names]), F.col("idx")).alias("label")
    return cells.groupBy("idx").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.col("hits").cast("bigint")).alias("n_positive"),
        (F.abs(F.avg("probs") - share) < 1e-3).alias("balanced"),
        (log_loss < entropy).alias("better_than_share"),
    ).select(label, "n_rows", "n_positive", "balanced", "better_than_share")


def _length_model():
    """Loader of a stand-in for a model outside Spark: two probabilities from the text length.

    A nested function travels to the Python workers by value, so they need not import this module.
    """

    def load():
        def predict(texts: list[str]) -> np.ndarray:
            lengths = np.array([len(text) for text in texts], dtype=float)
            logits = np.stack([(lengths - 1000.0) / 1000.0, (500.0 - lengths) / 100.0], axis=1)
            return 1.0 / (1.0 + np.exp(-np.clip(logits, -60, 60)))

        return predict

    return load


@query
def external_scores(spark, sf_dir):
    names = ["long", "short", "unserved"]
    scored = score_external(t.comments(spark, sf_dir), _length_model(), names)
    columns = [F.round(F.get("probs", F.lit(i)), 6).alias(n) for i, n in enumerate(names)]
    return scored.select("doc_id", "skip_reason", *columns)


@query
def external_predictions(spark, sf_dir):
    rows = t.documents(spark, sf_dir).select("doc_id", "text")
    predicted = predict_external(rows, _length_model(), ["long", "short"], strict=False)
    return predicted.select("doc_id", _joined("predicted").alias("predicted"))


# ---- summaries


@query
def run_summary(spark, sf_dir):
    return summary.run_summary(t.tagged(spark, sf_dir))


@query
def category_counts(spark, sf_dir):
    return summary.category_counts(t.tagged(spark, sf_dir))


@query
def category_summary(spark, sf_dir):
    return summary.category_summary(t.tagged(spark, sf_dir), SUMMARY_CATEGORIES)


@query
def category_top5(spark, sf_dir):
    return summary.top_categories(
        summary.category_summary(t.tagged(spark, sf_dir), SUMMARY_CATEGORIES)
    )


@query
def file_results(spark, sf_dir):
    return summary.file_results(_triaged(spark, sf_dir))


@query
def batch_summary(spark, sf_dir):
    return summary.batch_summary(summary.file_results(_triaged(spark, sf_dir)))


@query
def per_file_skips(spark, sf_dir):
    return triage.per_file_skips(_triaged(spark, sf_dir))


@query
def combined_output(spark, sf_dir):
    parts = [
        ("documents", t.documents(spark, sf_dir).select("doc_id", "text", "lang")),
        ("conversations", t.table(spark, sf_dir, "conversations")),
    ]
    united = sinks.combined(parts)
    return united.select(
        "source_file", "doc_id", "conv_id", "turn", "role", "lang", F.md5("text").alias("text_md5")
    )


# ---- files


def _table_paths(sf_dir: str, *names: str) -> list[str]:
    return [f"{sf_dir.rstrip('/')}/{name}.parquet" for name in names]


@query
def file_admission(spark, sf_dir):
    listing = sources.list_files(spark, [sf_dir])
    return sources.admit_files(listing).drop("file_path")


def _awkward_files(spark, sf_dir) -> list[str]:
    """Comments as a folder of Parquet files, as CSV with bare carriage returns, and with surplus fields."""
    folder = fresh_folder(spark, "awkward")
    rows = t.comments(spark, sf_dir)
    # Each is written by the tasks that read the table: as many files as these.
    rows.write.parquet(f"{folder}/folder.parquet")
    flat = rows.select("doc_id", F.col("lang").alias("text"))
    flat.write.option("header", True).option("lineSep", "\r").csv(f"{folder}/returns.csv")
    line = F.concat_ws(",", "doc_id", "text", F.when(F.col("doc_id") % 10 == 0, "surplus"))
    # One column of text, written as it is: its name and cells are the lines of the files.
    plain = flat.select(line.alias("doc_id,text"))
    plain.write.option("header", True).option("quote", "").option("escape", "").option("sep", "\u0001").csv(f"{folder}/surplus.csv")
    return [f"{folder}/{name}" for name in ("folder.parquet", "returns.csv", "surplus.csv")]


@query
def file_precheck(spark, sf_dir):
    paths = _table_paths(sf_dir, "documents", "conversations", "benchmark", "labels", "absent")
    report = sources.validate_files(spark, [*paths, _awkward_files(spark, sf_dir)[0]]).report
    return report.select("source_file", "status", "n_rows")


@query
def csv_records(spark, sf_dir):
    """Records of awkward CSV files: any line end counts as one, surplus fields are counted."""
    _, *folders = _awkward_files(spark, sf_dir)
    listed = [sources.list_files(spark, [folder]).filter("suffix = '.csv'").select("file_path") for folder in folders]
    returns, surplus = ([r["file_path"] for r in paths.collect()] for paths in listed)
    rows = sources.read_csv(spark, returns)
    misfits = sources.read_csv(spark, surplus, misfit_col=sources.MISFIT)
    counted = misfits.groupBy("text").agg(F.count("*").alias("n_rows"), F.count(sources.MISFIT).alias("n_misfits"))
    plain = rows.groupBy("text").agg(F.count("*").alias("n_rows"), F.lit(0).cast("bigint").alias("n_misfits"))
    return plain.select(F.lit("returns").alias("file"), "*").unionByName(counted.select(F.lit("surplus").alias("file"), "*"))


@query
def file_names(spark, sf_dir):
    """Names of the outputs for a path that is handed in; a folder of part files is one input."""
    requested = sources.data_files(spark, _table_paths(sf_dir, "documents")).select(F.col("requested").alias("path"), "bare")
    stamp = path_functions.run_stamp(F.lit("2024-01-02 03:04:05").cast("timestamp"))
    per_file = (
        t.documents(spark, sf_dir)
        .groupBy(sources.bare_path(sources.plain_path(F.col("_metadata.file_path"))).alias("bare"))
        .agg(F.count("*").alias("n"))
    )
    return (
        per_file.join(requested, "bare")
        .groupBy("path")
        .agg(F.sum("n").alias("n"))
        .select(
            path_functions.file_stem(F.col("path")).alias("stem"),
            path_functions.file_suffix(F.col("path")).alias("suffix"),
            path_functions.output_name(F.col("path"), "classified_", stamp).alias("output"),
            "n",
        )
    )


def _comments_as_csv(spark, sf_dir) -> list[str]:
    """The comments as CSV files of two layouts whose columns stand in different orders."""
    folder = fresh_folder(spark, "csv")
    rows = t.comments(spark, sf_dir)
    english = F.col("lang") == "en"
    sinks.save(rows.filter(english).select("doc_id", "lang", "text"), f"{folder}/a", "csv")
    sinks.append(rows.filter(~english).select("text", "doc_id", "lang"), f"{folder}/b", "csv")
    listing = sources.list_files(spark, [f"{folder}/a", f"{folder}/b"])
    return [r["file_path"] for r in listing.filter("suffix = '.csv'").select("file_path").collect()]


@query
def csv_scan(spark, sf_dir):
    """Write every comment to CSV, read it back by header name, triage it."""
    rows = sources.read_csv(spark, _comments_as_csv(spark, sf_dir))
    triaged = triage.with_skip_reason(rows, null_reason=NAN)
    return triaged.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "lang",
        "skip_reason",
        F.md5("text").alias("text_md5"),
    )


@query
def csv_spanning_scan(spark, sf_dir):
    """Comments whose fields run over line ends, from files that are read in parts."""
    rows = sources.read_csv(spark, _comments_as_csv(spark, sf_dir), misfit_col=sources.MISFIT, split_bytes=0)
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "lang",
        F.md5("text").alias("text_md5"),
        F.regexp_count("text", F.lit("\n")).cast("bigint").alias("line_ends"),
        F.col(sources.MISFIT).isNotNull().alias("misfit"),
    )


@query
def csv_encodings(spark, sf_dir):
    """Rows per detected encoding of the files they were written to."""
    paths = _comments_as_csv(spark, sf_dir)
    facts = materialise(sources.text_facts(spark, paths), "csv-facts")
    rows = sources.read_csv(spark, paths, facts=facts).groupBy("file_path").agg(F.count("*").alias("n"))
    return rows.join(facts, "file_path").groupBy("encoding").agg(F.sum("n").alias("n_rows"))


@query
def labelled_scan(spark, sf_dir):
    """Write labelled rows to CSV with delimited label cells, read them back as arrays."""
    folder = fresh_folder(spark, "labelled-csv")
    rows = t.labelled(spark, sf_dir).select("doc_id", F.col("text").alias("comment"), "labels")
    sinks.save(rows, folder, "csv")
    paths = sources.list_files(spark, [folder]).filter("suffix = '.csv'").select("file_path")
    scanned = read_labelled(
        spark, [r["file_path"] for r in paths.collect()], "comment", "labels", ["doc_id"]
    )
    return scanned.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.md5("text").alias("text_md5"),
        _joined("labels").alias("labels"),
    )


@query
def canonical_table(spark, sf_dir):
    """Labelled tables with null texts and with numbers for texts, in the layout that training takes."""
    documents = t.documents(spark, sf_dir)
    text = F.when(F.col("doc_id") % 7 > 0, F.col("text"))
    tables = [documents.select("doc_id", column.alias("text"), F.col("lang").alias("labels")) for column in (text, F.col("n_chars"))]
    canonical = [label_ops.labelled_table(df, keep=["doc_id"]).withColumn("form", F.lit(name)) for df, name in zip(tables, ("text", "number"))]
    rows = canonical[0].unionByName(canonical[1])
    return rows.select("doc_id", "form", F.md5("text").alias("text_md5"), _joined("labels").alias("labels"))


@query
def required_columns(spark, sf_dir):
    """Tables judged for the columns of labelled data: their rows, or the message that names what is missing."""
    found = []
    for name in ("documents", "conversations", "benchmark", "labels"):
        rows, message = t.table(spark, sf_dir, name), None
        try:
            rows = triage.require_columns(rows, ["doc_id", "text"])
        except MissingColumnError as error:
            rows, message = rows.filter(F.lit(False)), str(error)
        label = F.lit(name).alias("table_name")
        found.append(rows.agg(F.count("*").alias("n_rows")).select(label, "n_rows", F.lit(message).cast("string").alias("message")))
    return sources.union_by_name(found)


@query
def labelled_surplus(spark, sf_dir):
    """Labelled CSV rows of which every tenth has a label more than the header: reported, none lost silently."""
    folder = fresh_folder(spark, "labelled-surplus")
    line = F.concat_ws(",", "doc_id", F.concat(F.lit('"a, ""b""'), F.col("n_chars"), F.lit('"')), "lang", F.when(F.col("doc_id") % 10 == 0, F.col("source")))
    # One column of text, written as it is: its name and cells are the lines of the files.
    plain = t.documents(spark, sf_dir).select(line.alias("doc_id,comment,labels"))
    plain.write.option("header", True).option("quote", "").option("escape", "").option("sep", "\u0001").csv(f"{folder}/surplus.csv")
    rows = read_labelled(spark, [f"{folder}/surplus.csv"], "comment", "labels", ["doc_id"], surplus_col="surplus")
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", _joined("labels").alias("labels"), "surplus")


@query
def batch_run(spark, sf_dir):
    """Score two folders of CSV files in one run, plus one path that does not exist."""
    paths = _comments_as_csv(spark, sf_dir)
    folders = sorted({path.rsplit("/", 1)[0] for path in paths})
    run = jobs.process_files(
        spark,
        [*folders, paths[0] + ".absent.csv"],
        _fit(spark, sf_dir),
        fresh_folder(spark, "classified"),
        combine=True,
    )
    return run.files.agg(
        F.count_if(F.col("check") == "not_found").alias("not_found"),
        F.sum("total_rows").alias("total_rows"),
        F.sum("processed").alias("processed"),
        F.sum("skipped").alias("skipped"),
    )


@query
def dry_run(spark, sf_dir):
    """Profile every text table as a file, with one that lacks the column and one that is absent."""
    paths = _table_paths(sf_dir, "documents", "conversations", "benchmark", "labels", "absent")
    report = jobs.dry_run(spark, paths)
    return report.select(
        "file", "status", "total_rows", "empty_rate", "avg_text_length", "max_text_length", "encoding",
        (F.col("size_bytes") > 0).alias("has_size"), issue_codes().alias("issues"), "error",
    )


@query
def inference_run(spark, sf_dir):
    """Predictions for every document, a tenth of them without a key: category counts of the run."""
    run = jobs.run_inference(
        t.documents(spark, sf_dir).select(F.when(F.col("doc_id") % 10 > 0, F.col("doc_id")).alias("doc_id"), "text"),
        _fit(spark, sf_dir),
        "doc_id",
        output=fresh_folder(spark, "inference"),
        strict=False,
    )
    return run.categories


# ---- streaming


DOCUMENT_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@query
def stream_skip_counts(spark, sf_dir):
    """Running skip counters over the comments, arriving as files."""
    folder = fresh_folder(spark, "arriving")
    t.comments(spark, sf_dir).select("doc_id", "text").write.parquet(folder)
    stream = streaming.read_arriving(spark, folder, "doc_id BIGINT, text STRING")
    output, checkpoint = fresh_folder(spark, "counters"), fresh_folder(spark, "progress")
    streaming.running_counts(stream, output, checkpoint).awaitTermination()
    return streaming.latest_counts(spark, output)


@query
def stream_category_counts(spark, sf_dir):
    folder = fresh_folder(spark, "arriving")
    t.tagged(spark, sf_dir).write.parquet(folder)
    stream = streaming.read_arriving(spark, folder, "doc_id BIGINT, labels ARRAY<STRING>")
    output, checkpoint = fresh_folder(spark, "counters"), fresh_folder(spark, "progress")
    streaming.running_category_counts(stream, output, checkpoint).awaitTermination()
    return streaming.latest_counts(spark, output)


@query
def stream_progress(spark, sf_dir):
    """Rows reported by the progress of the stream, next to the rows a batch job observed."""
    folder = fresh_folder(spark, "arriving")
    t.documents(spark, sf_dir).select("doc_id", "lang").repartition(12).write.parquet(folder)
    stream = streaming.read_arriving(spark, folder, "doc_id BIGINT, lang STRING", files_per_trigger=1)
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    log = streaming.ProgressLog(spark)
    try:
        running = streaming.running_counts(
            stream, fresh_folder(spark, "counters"), fresh_folder(spark, "progress"), text_col="lang"
        )
        running.awaitTermination()
        streamed = sum(rows for _, rows in log.rows(running))
    finally:
        log.close()
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    watched, rows = streaming.observed(t.documents(spark, sf_dir).select("doc_id"), "documents")
    materialise(watched, "observed")
    return spark.createDataFrame([(streamed, rows())], "streamed BIGINT, observed BIGINT")


@query
def stream_classify(spark, sf_dir):
    """Documents scored as they arrive."""
    stream = streaming.read_arriving(
        spark, sf_dir, DOCUMENT_SCHEMA, pattern="documents.parquet"
    )
    model = _fit(spark, sf_dir)
    output, checkpoint = fresh_folder(spark, "stream-out"), fresh_folder(spark, "progress")
    streaming.classify_arriving(stream, model, "doc_id", output, checkpoint).awaitTermination()
    written = spark.read.parquet(f"{output}/batch=*")
    return written.select("doc_id", "skip_reason", _joined("predicted").alias("predicted"))


@query
def stream_classify_csv(spark, sf_dir):
    """Comments that arrive as CSV files of two layouts, bound by header and scored."""
    paths = _comments_as_csv(spark, sf_dir)
    folder = paths[0].rsplit("/", 2)[0]
    model = _fit(spark, sf_dir)
    output, checkpoint = fresh_folder(spark, "stream-out"), fresh_folder(spark, "progress")
    for name in sorted({path.rsplit("/", 2)[1] for path in paths}):
        query = streaming.classify_arriving_csv(
            spark, f"{folder}/{name}", model, f"{output}/from={name}", f"{checkpoint}/{name}", null_reason=NAN
        )
        query.awaitTermination()
    written = spark.read.option("mergeSchema", True).parquet(f"{output}/from=*/batch=*")
    return written.select(F.col("doc_id").cast("bigint").alias("doc_id"), "skip_reason", _joined("predicted").alias("predicted"))


@query
def stream_quarantine(spark, sf_dir):
    """Good files, then, after a restart, files without the column and files in which every tenth record has
    a field too many: the ledger by folder, next to the rows that came through."""
    folder = fresh_folder(spark, "arriving-csv")
    model = _fit(spark, sf_dir)
    output, ledger, checkpoint = (fresh_folder(spark, name) for name in ("stream-out", "ledger", "progress"))

    def run() -> None:
        query = streaming.classify_arriving_csv(spark, f"{folder}/*", model, output, checkpoint, ledger=ledger)
        query.awaitTermination()

    documents = t.documents(spark, sf_dir)
    sinks.save(documents.select("doc_id", "text"), f"{folder}/good", "csv")
    run()
    sinks.save(t.table(spark, sf_dir, "customer"), f"{folder}/lacking", "csv")
    line = F.concat_ws(",", "doc_id", F.concat(F.lit('"a, ""b""'), F.col("n_chars"), F.lit('"')), F.when(F.col("doc_id") % 10 == 0, F.col("lang")))
    plain = documents.select(line.alias("doc_id,text"))
    plain.write.option("header", True).option("quote", "").option("escape", "").option("sep", "\u0001").csv(f"{folder}/surplus")
    run()
    name = F.element_at(F.split("file_path", "/"), -2).alias("folder")
    rows = arrivals.published_rows(spark, output, ledger).groupBy(name).agg(F.count("doc_id").alias("published"))
    files = arrivals.file_status(spark, ledger).filter("status <> 'no_data'")
    told = files.groupBy(name, "status").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_surplus").alias("n_surplus"))
    dead = arrivals.dead_records(spark, ledger).groupBy(name).agg(F.max(F.md5("record")).alias("record_md5"))
    return told.join(rows, "folder", "left").join(dead, "folder", "left").na.fill(0)


@query
def chunk_rows_text_key(spark, sf_dir):
    """Row-range chunks in the order of a text key."""
    events = t.table(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_key"), "event_type")
    return with_chunks(events, "event_key", "event_type", 100, buckets=16)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the labelled texts, label every comment, count comments per category."""
    model = _fit(spark, sf_dir)
    scored = nb.score(t.comments(spark, sf_dir), model, "doc_id", null_reason=EMPTY)
    predicted = nb.with_predictions(scored, model)
    return summary.category_summary(predicted, model.labels, "predicted")


@query
def predicted_categories(spark, sf_dir):
    return flagship(spark, sf_dir)
