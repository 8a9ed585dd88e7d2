"""The spine of units, what exists of it, catalogues, neighbours, ledgers of runs and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glosswork.operators.ordering import numbered, running

SIDES = ("a", "b")


def parse_unit_ref(ref: Column) -> Column:
    """struct(collection, unit_no, side) of "Name 12b"; a bare "12b" has an empty collection; others give null."""
    pattern = r"^(?:(.*\S)\s+)?(\d+)([ab])$"
    parts = F.struct(F.regexp_extract(ref, pattern, 1).alias("collection"), F.regexp_extract(ref, pattern, 2).cast("int").alias("unit_no"), F.regexp_extract(ref, pattern, 3).alias("side"))
    return F.when(ref.rlike(pattern), parts)


def enumerate_units(collections: DataFrame, first: tuple[int, str] | None = None, last: tuple[int, str] | None = None) -> DataFrame:
    """Units 2a, 2b, 3a, ... of (collection, n), n of them, within inclusive bounds."""
    k = collections.where("n > 0").select("collection", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    units = k.select("collection", (F.floor((F.col("k") + 1) / 2) + 1).cast("int").alias("unit_no"), F.when(F.col("k") % 2 == 1, "a").otherwise("b").alias("side"))
    place = F.struct("unit_no", "side")
    bound = lambda b: F.struct(F.lit(b[0]).alias("unit_no"), F.lit(b[1]).alias("side"))
    if first:
        units = units.where(place >= bound(first))
    if last:
        units = units.where(place <= bound(last))
    return units


def expected_spine(collections: DataFrame, first_unit: int = 2) -> DataFrame:
    """All units and sides of (collection, last_unit)."""
    units = collections.where(F.col("last_unit") >= first_unit).select("collection", F.explode(F.sequence(F.lit(first_unit), F.col("last_unit").cast("int"))).alias("unit_no"))
    return units.select("collection", "unit_no", F.explode(F.array(*[F.lit(s) for s in SIDES])).alias("side"))


UNIT = ["collection", "unit_no", "side"]


def missing_units(spine: DataFrame, done: DataFrame) -> DataFrame:
    return spine.join(done.select(*UNIT), UNIT, "left_anti")


def windows_of(units: DataFrame, k: int = 5) -> DataFrame:
    """Consecutive groups of k units of each collection, and the first and last unit of each group."""
    placed = numbered(units.select("collection", "unit_id"), ["collection"], ["unit_id"], "place")
    placed = placed.withColumn("window_no", F.floor((F.col("place") - 1) / k).cast("int"))
    whole = Window.partitionBy("collection", "window_no")
    return placed.select("collection", "window_no", "unit_id", F.concat_ws("-", F.min("unit_id").over(whole), F.max("unit_id").over(whole)).alias("label"))


def windows_pending(windows: DataFrame, done: DataFrame, redo: bool = False) -> DataFrame:
    """Windows of which some unit is not done; all of them with ``redo``."""
    j = windows.join(done.select("unit_id").distinct().withColumn("have", F.lit(True)), "unit_id", "left")
    g = j.groupBy("collection", "window_no").agg(F.count(F.lit(1)).alias("units"), F.count("have").alias("done"))
    return g if redo else g.where("done < units")


def build_catalogue(docs: DataFrame) -> DataFrame:
    """One entry a document, with defaults, in order of collection and id."""
    topic = F.coalesce(F.when(F.trim(F.split("text", "\n")[0]) != "", F.split("text", "\n")[0]), F.lit("(no topic)"))
    return docs.select("doc_id", F.coalesce("source", F.lit("Other")).alias("collection"), topic.alias("main_topic"), F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".json")).alias("file")).orderBy("collection", "doc_id")


def catalogue_of_analyses(units: DataFrame) -> DataFrame:
    """The seven fields of a catalogue for read analyses (with their file), missing ones blank, number 0 and side a, in order
    of collection, number and side.
    """
    blank = {"ref": "", "collection": "", "unitNo": 0, "side": "a", "mainTopic": "", "generatedAt": "", "file": ""}
    return units.select(*[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in blank.items()]).orderBy("collection", "unitNo", "side")


def filter_catalogue(entries: DataFrame, needle: str, fields: list[str], collection: str) -> DataFrame:
    """Entries that contain the needle in any field, case-insensitive, counted by collection beside all."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(f), F.lit(needle.lower()))
    c = F.coalesce(F.col(collection), F.lit("Other"))
    return entries.groupBy(c.alias("collection")).agg(F.count(F.when(hit, 1)).alias("shown"), F.count(F.lit(1)).alias("total")).where("shown > 0")


def availability(units: DataFrame) -> DataFrame:
    """Per collection and unit the sides that exist, joined in order."""
    return units.groupBy("collection", "unit_no").agg(F.array_join(F.array_sort(F.collect_set("side")), "").alias("sides"))


def neighbours(entries: DataFrame) -> DataFrame:
    """The entry before and after each one of its collection; demonstration entries are passed over."""
    real = entries.where(~F.contains("file", F.lit(".demo."))).select("collection", "doc_id", "file")
    placed = numbered(real, ["collection"], ["doc_id"], "place")
    beside = lambda by, name: placed.select("collection", (F.col("place") + by).alias("place"), F.col("file").alias(name))
    keys = ["collection", "place"]
    return placed.join(beside(1, "previous"), keys, "left").join(beside(-1, "following"), keys, "left").select("collection", "doc_id", "previous", "following")


def usage_by_pass(usage: DataFrame) -> DataFrame:
    """Seconds, tokens and (of priced usage) dollars per pass and over all (pass null); usage without a pass is unknown."""
    p = usage.withColumn("pass", F.coalesce("pass", F.lit("unknown")))
    usd = [F.round(F.sum("usd"), 6).alias("usd")] if "usd" in usage.columns else []
    return p.rollup("pass").agg(F.round(F.sum("seconds"), 4).alias("seconds"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("calls"), *usd)


def price_usage(usage: DataFrame, prices: DataFrame, free_providers: tuple[str, ...] = ("local",)) -> DataFrame:
    """Adds usd by prices (price_model, input, output) a million tokens: the exact model, else the longest listed prefix, else 0.

    Calls whose ``provider``, where usage has one, is a free one cost 0. Models are few next to calls, so each model is
    priced once.
    """
    models = usage.select("model").distinct()
    hit = models.join(F.broadcast(prices), F.col("model").startswith(F.col("price_model")))  # a price list written by people
    best = hit.groupBy("model").agg(F.max_by(F.struct("input", "output"), F.length("price_model")).alias("p"))
    j = usage.join(best, "model", "left")
    usd = (F.col("input_tokens") * F.col("p.input") + F.col("output_tokens") * F.col("p.output")) / 1e6
    free = F.coalesce(F.col("provider").isin(*free_providers), F.lit(False)) if "provider" in usage.columns else F.lit(False)
    return j.select(*usage.columns, F.when(free, 0.0).otherwise(F.coalesce(usd, F.lit(0.0))).alias("usd"))


def last_model_per_pass(usage: DataFrame) -> DataFrame:
    return usage.groupBy("pass").agg(F.max_by("model", "seq").alias("model"))


def run_eta(runs: DataFrame, planned: int) -> DataFrame:
    """After every run of a collection: elapsed, mean and remaining minutes, with and without the skipped runs in the mean."""
    built = ~F.col("skipped")
    sums = {"i": F.lit(1).cast("long"), "elapsed": F.col("minutes"), "worked": F.when(built, F.col("minutes")), "real": F.when(built, 1).cast("long")}
    e = running(runs.select("collection", "seq", "at", "minutes", "skipped"), ["collection"], ["at", "seq"], sums)
    left = F.lit(planned) - F.col("i")
    return e.select("collection", "seq", "elapsed", (F.col("elapsed") / F.col("i")).alias("mean_all"), F.when(F.col("real") > 0, F.col("worked") / F.col("real")).alias("mean_built"), F.floor(F.col("elapsed") / F.col("i") * left).alias("eta_all"))


def latest_status(runs: DataFrame) -> DataFrame:
    """The last result of every window."""
    g = runs.groupBy("run_key").agg(F.max_by(F.struct("status", "skipped", "minutes"), F.struct("at", "seq")).alias("last"))
    return g.select("run_key", "last.status", "last.skipped", F.round("last.minutes", 4).alias("minutes"))


def retry_rounds(runs: DataFrame, rounds: int = 2) -> DataFrame:
    """Per window its attempts among the first and ``rounds`` retries, and whether one succeeded; else it failed for good."""
    w = Window.partitionBy("run_key").orderBy("at", "seq")
    tries = runs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= rounds + 1)
    ok = F.max(F.col("status") == "ok")
    return tries.groupBy("run_key").agg(F.count(F.lit(1)).alias("attempts"), ok.alias("succeeded"), F.min(F.when(F.col("status") == "ok", F.col("k"))).alias("first_ok"))


def run_totals(runs: DataFrame) -> DataFrame:
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    ok = F.col("status") == "ok"
    return runs.groupBy("collection").agg(n(ok & ~F.col("skipped"), "ok"), n(F.col("skipped"), "skipped"), n(~ok, "failed"))


def parse_run_key(key: Column) -> Column:
    """struct(collection, first, last) of "<collection>/window/<first>-<last>"; a single unit is first and last."""
    pattern = r"^(.*)/window/([^-]+)(?:-(.+))?$"
    first, last = F.regexp_extract(key, pattern, 2), F.regexp_extract(key, pattern, 3)
    return F.when(key.rlike(pattern), F.struct(F.regexp_extract(key, pattern, 1).alias("collection"), first.alias("first"), F.when(last == "", first).otherwise(last).alias("last")))


def explode_manifest(manifests: DataFrame) -> DataFrame:
    """Rows of the map results<key, struct> of manifests, with their keys parsed."""
    rows = manifests.select(F.explode("results").alias("run_key", "r"))
    return rows.select("run_key", parse_run_key(F.col("run_key")).alias("k"), "r.*").select("run_key", "k.collection", "k.first", "k.last", "status", "skipped", "message")


def effort_correlation(effort: DataFrame, size: str, minutes: str) -> DataFrame:
    return effort.agg(F.round(F.corr(size, minutes), 6).alias("r"), F.count(F.lit(1)).alias("n"))


def parse_pass_progress(log: DataFrame) -> DataFrame:
    """Per run the last pass that its log names, with its message, how many passes there are, how many it has named, and for
    each pass in order whether it is done, that is, before the last one.
    """
    n = F.regexp_extract("msg", r"^Pass (\d+)/(\d+): (.*)$", 1).try_cast("int")
    of = F.regexp_extract("msg", r"^Pass (\d+)/(\d+): (.*)$", 2).try_cast("int")
    said = F.regexp_extract("msg", r"^Pass (\d+)/(\d+): (.*)$", 3)
    named = log.select("run_id", "ts", "seq", n.alias("n"), of.alias("of"), said.alias("said")).where("n is not null")
    g = named.groupBy("run_id").agg(F.max_by(F.struct("n", "said"), F.struct("ts", "seq")).alias("last"), F.max("of").alias("passes"), F.count_distinct("n").alias("passes_seen"))
    done = F.transform(F.sequence(F.lit(1), F.greatest("passes", F.lit(1))), lambda k: k < F.col("last.n"))
    return g.select("run_id", F.col("last.n").alias("last_pass"), F.col("last.said").alias("last_message"), "passes", "passes_seen", done.alias("done"))


def progress_tail(log: DataFrame, keep: int = 200) -> DataFrame:
    """The newest messages of every run."""
    w = Window.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("seq"))
    return log.withColumn("k", F.row_number().over(w)).where(F.col("k") <= keep).select("run_id", "seq", "msg", "k")


def stale_runs(log: DataFrame, now: Column, seconds: int = 30, done: str = "purchase") -> DataFrame:
    """Runs that are finished and have been silent for more than ``seconds``."""
    g = log.groupBy("run_id").agg(F.max("ts").alias("last_ts"), F.max_by("msg", F.struct("ts", "seq")).alias("last_msg"))
    idle = F.unix_seconds(F.to_timestamp(now)) - F.unix_seconds(F.col("last_ts").cast("timestamp"))
    return g.select("run_id", "last_msg", idle.alias("idle_seconds")).where((F.col("idle_seconds") > seconds) & (F.col("last_msg") == done))
