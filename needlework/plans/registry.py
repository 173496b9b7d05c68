"""The registered queries: (spark, sf_dir) -> DataFrame over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework import fixed
from needlework.functions import risk, text
from needlework.operators import corpus, evaluate, matching, measurements, sampling, states
from needlework.operators import dictionary as dicts
from needlework.plans import inputs
from needlework.sources import patterns, query_log, reports, sinks, store, timings
from needlework.streaming import scoring, versions, windows
from needlework.tables import SPREAD_SPLITS, kept, spread, work_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- sources and sinks -------------------------------------------------------


@query
def scan_query_log(spark, sf_dir):
    return query_log.parse_log(inputs.log_lines(spark, sf_dir)).select("qid", "query", "normalized", "expected")


@query
def scan_log_files(spark, sf_dir):
    """The log as CSV files of sets named by class and size, read back and counted per set."""
    path = work_dir(spark, "log-files")
    log = inputs.query_log(spark, sf_dir).select("query", "expected")
    for risk in fixed.LABELS:
        sinks.write_dataset(log.where(F.col("expected") == risk).withColumnRenamed("expected", "risk").withColumn("part", F.lit(0)), f"{path}/x_{risk.title()}_{len(risk)}.csv", ["part"])
    rows = query_log.parse_log(query_log.read_log_lines(spark, f"{path}/*/*", source=True))
    name = F.regexp_extract("file", r"_([A-Z][a-z]+)_(\d+)\.csv/", 1)
    size = F.regexp_extract("file", r"_([A-Z][a-z]+)_(\d+)\.csv/", 2)
    return rows.groupBy(F.lower(name).alias("set_risk"), size.alias("set_size"), "expected").agg(
        F.count("*").alias("n"), F.sum(F.char_length("normalized")).alias("characters")
    )


@query
def scan_query_log_naive(spark, sf_dir):
    return query_log.parse_log_naive(inputs.log_lines(spark, sf_dir)).select(
        "qid", "query", "normalized", "expected", "score"
    )


def _scan_files(files, found):
    return patterns.scan_patterns(files, found(F.col("value")), ["conv_id", "turn"])


@query
def scan_patterns_quoted(spark, sf_dir):
    return _scan_files(inputs.quoted_files(spark, sf_dir), patterns.quoted_patterns)


@query
def scan_patterns_lines(spark, sf_dir):
    return _scan_files(inputs.mixed_files(spark, sf_dir), patterns.loaded_patterns)


@query
def scan_patterns_strict(spark, sf_dir):
    return _scan_files(inputs.quoted_files(spark, sf_dir), patterns.strict_patterns)


@query
def scan_weighted_patterns(spark, sf_dir):
    return patterns.scan_weighted_patterns(inputs.weighted_lines(spark, sf_dir))


def _score_all(spark, log):
    """Every query under every way of counting, assessed; the third has its own weights and bounds."""
    short = dicts.standard_dictionary(spark, dicts.simple_weight)
    return evaluate.score_log_all(
        log, dicts.standard_dictionary(spark), first_weights=short, first_bounds=fixed.THRESHOLDS_V2
    )


def _runs(spark, sf_dir):
    return _score_all(spark, inputs.query_log(spark, sf_dir))


@query
def scan_run_reports(spark, sf_dir):
    path = work_dir(spark, "reports")
    first = reports.first_rows(inputs.query_log(spark, sf_dir), ["dataset"])
    shown = _score_all(spark, first)
    reports.write_run_reports(_runs(spark, sf_dir), shown, path, ["algorithm", "dataset"])
    parsed = reports.parse_reports(reports.read_reports(spark, path))
    return parsed.select("algorithm", "dataset", "loaded", "total", "correct", "accuracy", "zero_scores")


@query
def scan_benchmark_table(spark, sf_dir):
    return timings.parse_timings(inputs.timing_lines(spark, sf_dir))


@query
def write_run_report(spark, sf_dir):
    path = work_dir(spark, "metrics")
    dims = ["algorithm", "dataset", "expected"]
    matrix = evaluate.accuracy_matrix(_runs(spark, sf_dir), dims)
    cells = matrix.where(F.col("expected") != "(all)")
    reports.write_run_metrics(cells, path, dims[:2])
    return spark.read.parquet(path)


@query
def write_dataset(spark, sf_dir):
    path = work_dir(spark, "dataset")
    events = inputs.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("dataset"))
    rows = corpus.generate_dataset(events, "event_id")
    sinks.write_dataset(rows, path, ["dataset"])
    back = query_log.read_query_log(spark, path)
    return back.groupBy("query", "expected").agg(F.count("*").alias("n"))


@query
def scan_numbered_log(spark, sf_dir):
    """Data sets written per event type and read back with line numbers, which run from 1 in every file."""
    path = work_dir(spark, "numbered")
    events = inputs.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("dataset"))
    sinks.write_dataset(corpus.generate_dataset(events, "event_id"), path, ["dataset"])
    log = query_log.read_numbered_log(spark, path)
    per_file = log.groupBy("file").agg(
        F.count("*").alias("queries"), F.min("qid").alias("first"), F.max("qid").alias("last"), F.sum("qid").alias("numbers")
    )
    unbroken = (F.col("first") == 1) & (F.col("numbers") * 2 == F.col("last") * (F.col("last") + 1))
    return per_file.groupBy(F.regexp_extract("file", "dataset=([^/]+)", 1).alias("dataset")).agg(
        F.sum("queries").alias("queries"), F.sum("last").alias("last_numbers"), F.bool_and(unbroken).alias("unbroken")
    )


@query
def write_patterns(spark, sf_dir):
    path = work_dir(spark, "patterns")
    sinks.write_patterns(inputs.part_dictionary(spark, sf_dir), path)
    found = F.explode(patterns.strict_patterns(F.col("value"))).alias("pattern")
    return spark.read.text(path).select(found).groupBy("pattern").agg(F.count("*").alias("n"))


# --- projections and filters ---------------------------------------------------


@query
def normalize_query(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir)
    return docs.select("doc_id", text.normalize_query(F.col("text")).alias("normalized"))


@query
def trim_fields(spark, sf_dir):
    padded = F.concat(F.lit("\t \r\n"), F.col("text"), F.lit(" \r\n\t"))
    return inputs.documents(spark, sf_dir).select("doc_id", text.trim_field(padded).alias("trimmed"))


@query
def strip_outer_quotes(spark, sf_dir):
    wrapped = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('"'), F.col("text"), F.lit('"')))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit('"'), F.col("text")))
        .otherwise(F.col("text"))
    )
    return inputs.documents(spark, sf_dir).select("doc_id", text.strip_outer_quotes(wrapped).alias("bare"))


def _document_scores(spark, sf_dir):
    return matching.score_distinct(inputs.planted(spark, sf_dir), dicts.standard_dictionary(spark), "doc_id")


@query
def classify_risk_v1(spark, sf_dir):
    return _document_scores(spark, sf_dir).withColumn("computed", risk.classify_risk(F.col("score")))


@query
def classify_risk_v2(spark, sf_dir):
    computed = risk.classify_risk(F.col("score"), fixed.THRESHOLDS_V2)
    return _document_scores(spark, sf_dir).withColumn("computed", computed)


@query
def weight_patterns_tiered(spark, sf_dir):
    return inputs.log_dictionary(spark, sf_dir).withColumn("weight", dicts.tiered_weight(F.col("pattern")))


@query
def weight_patterns_simple(spark, sf_dir):
    return inputs.log_dictionary(spark, sf_dir).withColumn("weight", dicts.simple_weight(F.col("pattern")))


@query
def weight_lookup(spark, sf_dir):
    return dicts.weight_lookup(inputs.log_dictionary(spark, sf_dir))


@query
def expected_score(spark, sf_dir):
    log = inputs.loose_labels(inputs.query_log(spark, sf_dir))
    return log.select("qid", "label", risk.nominal_score(F.col("label")).alias("score"))


@query
def obfuscate_query(spark, sf_dir):
    variant = (F.col("qid") % 4).cast("int")
    log = inputs.query_log(spark, sf_dir)
    return log.select("qid", text.obfuscate_query(F.col("query"), variant).alias("variation"))


def _assessed(spark, sf_dir):
    return evaluate.score_log(inputs.query_log(spark, sf_dir), dicts.standard_dictionary(spark))


@query
def match_flag(spark, sf_dir):
    return _assessed(spark, sf_dir).select("qid", "score", "computed", "expected", "flag")


@query
def filter_valid_labels(spark, sf_dir):
    log = inputs.loose_labels(inputs.query_log(spark, sf_dir))
    return query_log.filter_valid_labels(log, "label").select("qid", "query", "label")


@query
def filter_blank_lines(spark, sf_dir):
    lines = F.filter(F.split("text", "\n", -1), lambda line: patterns.is_pattern_line(line))
    return inputs.documents(spark, sf_dir).select("doc_id", F.size(lines).cast("bigint").alias("kept_lines"))


@query
def filter_zero_score(spark, sf_dir):
    found = matching.detect_none(inputs.planted(spark, sf_dir), dicts.standard_dictionary(spark), "doc_id")
    return found.select("doc_id")


@query
def filter_mismatch(spark, sf_dir):
    rows = evaluate.filter_mismatch(_assessed(spark, sf_dir))
    return rows.select("qid", "score", "computed", "expected")


# --- dictionary ------------------------------------------------------------------


@query
def dictionary_trie_stats(spark, sf_dir):
    return dicts.trie_stats(inputs.part_dictionary(spark, sf_dir))


@query
def dictionary_implications(spark, sf_dir):
    return matching.implications(inputs.part_dictionary(spark, sf_dir))


@query
def dictionary_direct_implications(spark, sf_dir):
    return matching.direct_implications(inputs.part_dictionary(spark, sf_dir))


@query
def dictionary_implication_order(spark, sf_dir):
    return matching.implication_order(inputs.part_dictionary(spark, sf_dir))


@query
def dictionary_duplicates(spark, sf_dir):
    return dicts.duplicates(inputs.part_dictionary(spark, sf_dir))


@query
def dictionary_limits(spark, sf_dir):
    return dicts.limits(inputs.part_dictionary(spark, sf_dir))


@query
def dictionary_preview(spark, sf_dir):
    return dicts.preview(inputs.part_dictionary(spark, sf_dir))


@query
def weight_distribution(spark, sf_dir):
    return dicts.weight_distribution(weight_patterns_tiered(spark, sf_dir))


# --- matching ----------------------------------------------------------------------


@query
def score_distinct(spark, sf_dir):
    return _document_scores(spark, sf_dir)


@query
def score_occurrences(spark, sf_dir):
    return matching.score_occurrences(inputs.planted(spark, sf_dir), dicts.standard_dictionary(spark), "doc_id")


@query
def score_occurrences_first_id(spark, sf_dir):
    dictionary = dicts.standard_dictionary(spark, dicts.simple_weight)
    scores = matching.score_occurrences_first_id(inputs.planted(spark, sf_dir), dictionary, "doc_id")
    return scores.withColumn("computed", risk.classify_risk(F.col("score"), fixed.THRESHOLDS_V2))


@query
def pattern_hits(spark, sf_dir):
    hits = matching.pattern_hits(inputs.planted(spark, sf_dir), dicts.standard_dictionary(spark), "doc_id")
    return hits.select("doc_id", "pid", "hits")


@query
def matched_patterns(spark, sf_dir):
    return matching.matched_patterns(inputs.planted(spark, sf_dir), dicts.plain_dictionary(spark), "doc_id")


@query
def match_positions(spark, sf_dir):
    return matching.match_positions(inputs.planted(spark, sf_dir), dicts.standard_dictionary(spark), "doc_id")


@query
def detect_any(spark, sf_dir):
    pages = spread(inputs.table(spark, sf_dir, "pages").select("page_id", "html"))
    texts = pages.select("page_id", text.normalize_query(F.col("html")).alias("normalized"))
    return matching.detect_any(texts, dicts.standard_dictionary(spark)).select("page_id")


@query
def score_large_dictionary(spark, sf_dir):
    words = inputs.word_dictionary(spark, sf_dir)
    return matching.score_distinct(inputs.planted(spark, sf_dir), words, "doc_id")


@query
def score_all_words(spark, sf_dir):
    words = inputs.word_dictionary(spark, sf_dir, least=1)
    return matching.score_distinct(inputs.planted(spark, sf_dir), words, "doc_id")


# --- evaluation ----------------------------------------------------------------------


@query
def accuracy(spark, sf_dir):
    return evaluate.accuracy(_assessed(spark, sf_dir))


@query
def zero_score_share(spark, sf_dir):
    scores = _document_scores(spark, sf_dir).withColumn("expected", F.lit("low"))
    return evaluate.zero_score_share(evaluate.assess(scores))


@query
def score_stats(spark, sf_dir):
    return evaluate.score_stats(_assessed(spark, sf_dir))


@query
def accuracy_matrix(spark, sf_dir):
    return evaluate.accuracy_matrix(_runs(spark, sf_dir), ["algorithm", "expected", "dataset"])


@query
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_assessed(spark, sf_dir))


@query
def pattern_frequency(spark, sf_dir):
    return evaluate.pattern_frequency(pattern_hits(spark, sf_dir))


@query
def algorithm_agreement(spark, sf_dir):
    return evaluate.algorithm_agreement(inputs.planted(spark, sf_dir), dicts.standard_dictionary(spark), "doc_id")


@query
def throughput(spark, sf_dir):
    timed = measurements.throughput(scan_benchmark_table(spark, sf_dir))
    return timed.select("nr", "algorithm", "dataset_size", "time_us", "queries_per_second")


@query
def preview_queries(spark, sf_dir):
    return evaluate.preview_queries(_assessed(spark, sf_dir))


@query
def preview_generated(spark, sf_dir):
    made = generate_dataset(spark, sf_dir)
    first = evaluate.preview_per_class(made, "risk", "event_id").select(
        "risk", "rank", "event_id", "query", text.normalize_query(F.col("query")).alias("normalized")
    )
    found = matching.matched_patterns(first, dicts.plain_dictionary(spark), ["risk", "rank", "event_id", "query"])
    return found


# --- corpus ------------------------------------------------------------------------------


@query
def template_catalog(spark, sf_dir):
    """How often the log uses each template of the catalog."""
    used = inputs.query_log(spark, sf_dir).groupBy("query").agg(F.count("*").alias("used"))
    catalog = F.broadcast(corpus.template_catalog(spark))
    return catalog.join(used, F.col("template") == F.col("query"), "left").select(
        "tid", "risk", "idx", "template", F.coalesce("used", F.lit(0).cast("bigint")).alias("used")
    )


def _event_keys(spark, sf_dir):
    return spread(inputs.table(spark, sf_dir, "events").select("event_id"))


@query
def sample_templates(spark, sf_dir):
    return corpus.sample_templates(_event_keys(spark, sf_dir), "event_id").select("event_id", "risk", "template")


@query
def adjust_to_target(spark, sf_dir):
    rows = sample_templates(spark, sf_dir)
    return corpus.adjust_to_target(rows, "event_id").select("event_id", "risk", "final_query", "score")


@query
def generate_dataset(spark, sf_dir):
    return corpus.generate_dataset(_event_keys(spark, sf_dir), "event_id")


@query
def generate_matrix(spark, sf_dir):
    """One data set per event type and class, as large as the type has events."""
    events = inputs.table(spark, sf_dir, "events")
    sizes = events.groupBy(F.col("event_type").alias("dataset")).agg(F.count("*").alias("size"))
    made = corpus.generate_matrix(sizes)
    return made.groupBy("dataset", "risk").agg(F.count("*").alias("queries"), F.sum("score").alias("score_sum"))


@query
def dataset_store_matrix(spark, sf_dir):
    """Sets of five sizes per class: written, one replaced, evaluated one by one, and merged into one matrix."""
    path = work_dir(spark, "sets")
    log = inputs.query_log(spark, sf_dir).select("qid", "query", "expected", "normalized").cache()
    for size in fixed.MATRIX_SIZES:
        taken = sampling.exact_sample(log, "expected", size, "qid")
        store.write_sets(taken.select("query", "expected", "normalized", F.col("expected").alias("set_risk"), F.lit(size).alias("set_size")), f"{path}/sets")
    # the set of a hundred critical queries anew, with all queries in it labelled high
    hundred = store.read_sets(spark, f"{path}/sets", ["Critical_100"])
    again = kept(hundred.withColumn("expected", F.lit("high")), "again")
    store.write_sets(again, f"{path}/sets")
    log.unpersist()
    words = dicts.standard_dictionary(spark)
    for size in fixed.MATRIX_SIZES:
        names = [f"{risk}_{size}" for risk in fixed.LABELS]
        states.add_sets(evaluate.score_log(store.read_sets(spark, f"{path}/sets", names), words, key="query"), f"{path}/states")
    found = states.read_states(spark, f"{path}/states")
    cells = states.results(states.merged(found, ["set_risk", "set_size"]).withColumn("set_size", F.col("set_size").cast("string")))
    whole = states.results(states.merged(found).withColumns({"set_risk": F.lit("(all)"), "set_size": F.lit("(all)")}))
    names = ["set_risk", "set_size", "total", "correct", "accuracy", "zero_scores", "min_score", "max_score", "avg_score"]
    return cells.select(*names).unionByName(whole.select(*names))


@query
def generate_variations(spark, sf_dir):
    base = inputs.query_log(spark, sf_dir).select("qid", "query", F.col("expected").alias("risk"))
    return corpus.generate_variations(base).select("qid", "risk", "variant", "variation", "score")


@query
def inject_payloads(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir)
    return corpus.inject_payloads(docs, "doc_id", "text", inputs.PAYLOADS, inputs.CYCLE).select("doc_id", "text")


# --- timings ----------------------------------------------------------------------------------


@query
def benchmark_by_algorithm(spark, sf_dir):
    return measurements.by_algorithm(scan_benchmark_table(spark, sf_dir), ["distinct", "occurrences"])


@query
def parameter_grid(spark, sf_dir):
    runs = scan_benchmark_table(spark, sf_dir).groupBy("algorithm", "risk").agg(F.count("*").alias("timings"))
    return measurements.parameter_grid(runs)


@query
def nearest_measurement(spark, sf_dir):
    return measurements.nearest_measurement(scan_benchmark_table(spark, sf_dir))


@query
def modelled_time(spark, sf_dir):
    surface = measurements.time_surface(scan_benchmark_table(spark, sf_dir))
    return surface.select("algorithm", "p", "s", F.round("time_us", 6).alias("time_us"))


# --- streaming ----------------------------------------------------------------------------------


def _stream(spark, sf_dir, name):
    schema = inputs.table(spark, sf_dir, name).schema
    # one file is one split; its rows are dealt out so that no single task scans them all
    parts = min(spark.sparkContext.defaultParallelism, SPREAD_SPLITS)
    return scoring.read_stream(spark, sf_dir, schema, f"{name}.parquet", partitions=parts)


@query
def stream_score(spark, sf_dir):
    path = work_dir(spark, "stream-score")
    patterns_ = matching.small_patterns(dicts.standard_dictionary(spark))
    log = inputs.plant(_stream(spark, sf_dir, "documents")).withColumn("expected", F.lit("low"))
    scored = scoring.stream_score(log, patterns_).select("doc_id", "score", "computed")
    scoring.run_to_files(scored, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{path}/rows")


@query
def stream_risk_windows(spark, sf_dir):
    path = work_dir(spark, "stream-windows")
    patterns_ = matching.small_patterns(dicts.standard_dictionary(spark))
    # The column carries no zone and means UTC; a watermark needs an instant.
    instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    events = _stream(spark, sf_dir, "events").withColumn("ts", instant)
    assessed = scoring.stream_score(inputs.label_events(events), patterns_)
    counts = scoring.stream_risk_windows(assessed)
    scoring.run_updates_to_files(counts, f"{path}/counts", f"{path}/checkpoint").awaitTermination()
    latest = scoring.latest_counts(spark, f"{path}/counts")
    day = F.date_from_unix_date((F.unix_timestamp("window_start") / 86400).cast("int"))
    return latest.select(day.cast("string").alias("day"), "computed", "n")


def _event_files(spark, sf_dir, path, copies=1):
    """The events as a stream of files that are out of order, each ``copies`` times; two files a micro-batch."""
    instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    events = inputs.table(spark, sf_dir, "events").select("event_id", "event_type", instant.alias("ts"))
    for copy in range(copies):
        events.repartition(10, F.xxhash64("event_id")).write.mode("append").parquet(path)
    return scoring.read_stream(spark, path, events.schema, files_per_batch=2)


def _day(column):
    return F.date_from_unix_date((F.unix_timestamp(column) / 86400).cast("int")).cast("string").alias("day")


@query
def stream_final_windows(spark, sf_dir):
    path = work_dir(spark, "stream-final")
    patterns_ = matching.small_patterns(dicts.standard_dictionary(spark))
    assessed = scoring.stream_score(inputs.label_events(_event_files(spark, sf_dir, f"{path}/in")), patterns_)
    kept = assessed.select("qid", "ts", "computed")
    windows.run_final_windows(kept, f"{path}/out", f"{path}/checkpoint", delay="3 days").awaitTermination()
    return windows.all_counts(spark, f"{path}/out").select(_day("window_start"), "computed", "n")


@query
def stream_distinct_rows(spark, sf_dir):
    path = work_dir(spark, "stream-distinct")
    sent = _event_files(spark, sf_dir, f"{path}/in", copies=2)
    once_each = windows.distinct_rows(sent, ["event_id"], delay="3650 days")
    scoring.run_to_files(once_each, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    rows = spark.read.schema(once_each.schema).parquet(f"{path}/rows")
    return rows.groupBy("event_type", _day("ts")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query
def stream_versioned_score(spark, sf_dir):
    """Two versions of the dictionary; from the middle of the events on all weights are doubled."""
    path = work_dir(spark, "stream-versions")
    log = inputs.label_events(_event_files(spark, sf_dir, f"{path}/in"))
    middle = spark.read.parquet(f"{path}/in").agg(F.timestamp_seconds((F.unix_timestamp(F.min("ts")) + F.unix_timestamp(F.max("ts"))).cast("bigint") / 2).alias("at"))
    words = dicts.standard_dictionary(spark).select("pid", "pattern", "weight")
    words.withColumn("valid_from", F.timestamp_seconds(F.lit(0))).write.parquet(f"{path}/versions")
    later = words.withColumn("weight", F.col("weight") * 2).join(F.broadcast(middle)).withColumnRenamed("at", "valid_from")
    later.select("pid", "pattern", "weight", "valid_from").write.mode("append").parquet(f"{path}/versions")
    versions.run_versioned_score(log, f"{path}/versions", f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    scores = versions.versioned_scores(spark, f"{path}/rows")
    return scores.groupBy(_day("ts"), "computed").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
