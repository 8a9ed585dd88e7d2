"""Nested analyses of units: reading, flattening, assembling, and the ingestion of exports, logs and model output."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, FractionalType, IntegralType, MapType, StructField, StructType

PHRASE = "struct<phraseNumber: int, source: string, translation: string, notes: string>"
TERM = "struct<term: string, meaning: string>"
COMMENT = f"struct<source: string, ref: string, text: string, translation: string, takeaway: string, phrases: array<{PHRASE}>>"
BUCKETS = ("first", "second", "third", "other")
COMMENTS = "struct<" + ", ".join(f"{b}: array<{COMMENT}>" for b in BUCKETS) + ", together: string>"
SPAN = "struct<spanNumber: int, startLine: int, endLine: int, topic: string, gist: string, opening: string, firstStep: int, lastStep: int>"
STEP_TEXTS = ("label", "title", "summary", "plain", "what", "deeper", "remember", "alert", "matters", "confidence", "otherLabel", "trigger", "phase", "branchRole", "scope", "relation")
# The keys of published documents, where they are not the names of the columns here ("within.column").
PUBLISHED = {
    ".collection": "masechet", ".unitNo": "daf", ".side": "amud", ".spans": "sugyaBoundaries", ".version": "pipelineVersion", ".models": "modelsUsed",
    "spans.spanNumber": "sugyaNumber", "spans.opening": "openingFormula", "spans.firstStep": "firstStepNumber", "spans.lastStep": "lastStepNumber",
    "steps.label": "hebrewStepName", "steps.summary": "stepSummary", "steps.plain": "simpleTranslation", "steps.what": "whatsHappening",
    "steps.deeper": "deeperAnalysis", "steps.remember": "whatToRemember", "steps.alert": "confusionAlert", "steps.matters": "whyThisMatters",
    "steps.confidence": "classificationConfidence", "steps.otherLabel": "alternativePossibleLabel", "steps.trigger": "triggerLanguage",
    "steps.phase": "macroPhase", "steps.dependsOn": "dependsOnStepNumbers", "steps.scope": "scopeOfStep", "steps.relation": "relationToPreviousStep",
    "steps.comments": "meforshim", "phrases.source": "aramaic", "phrases.translation": "english",
    "comments.first": "rashi", "comments.second": "tosafot", "comments.third": "rishonim", "comments.other": "acharonim", "comments.together": "interplaySummary",
    **{f"{b}.text": "hebrew" for b in BUCKETS}, **{f"{b}.translation": "english" for b in BUCKETS},
}
# Keys of what only steps of one label tell, under their own names here too.
LOGIC = (
    "kashyaTarget", "kashyaAttackLogic", "terutzResolutionType", "terutzHavaAmina", "terutzMaskana", "sheelahInformationSought",
    "teshuvahAnswerProvided", "raayaObject", "raayaSupportSource", "dechiyaRejectionScope", "dechiyaFlawIdentified", "mimraCoreRuling",
    "maskanaFinalTakeaway",
)
STEP = "struct<stepNumber: int, " + ", ".join(f"{t}: string" for t in (*STEP_TEXTS, *LOGIC)) + f", dependsOn: array<int>, keyTerms: array<{TERM}>, phrases: array<{PHRASE}>, comments: {COMMENTS}>"
COST = "struct<totalUSD: double, totalInputTokens: bigint, totalOutputTokens: bigint, byPass: map<string, double>>"
ANALYSIS = f"ref string, collection string, unitNo int, side string, mainTopic string, overview string, spans array<{SPAN}>, steps array<{STEP}>, version string, generatedAt string, models map<string, string>, cost {COST}"
UNIT_FILE = r"^[A-Za-z_]+_\d+[ab]\.json$"


def keyed(kind: DataType, keys: dict[str, str], within: str = "") -> DataType:
    """The same type with the documents' keys in place of the columns' names; arrays and structs are within their column."""
    if isinstance(kind, ArrayType):
        return ArrayType(keyed(kind.elementType, keys, within))
    if isinstance(kind, StructType):
        return StructType([StructField(keys.get(f"{within}.{f.name}", f.name), keyed(f.dataType, keys, f.name)) for f in kind])
    return kind


def read_analyses(spark: SparkSession, path: str, file_pattern: str | None = UNIT_FILE, multi_line: bool = True, keys: dict[str, str] = PUBLISHED) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) analyses of the JSON files whose names match: one document a file, or a line if not multi_line.

    ``keys`` tells the documents' keys where they differ from the columns' names; the default reads published documents.
    Quarantined, with a reason, are malformed documents, with their text, and those without a ref, spans or steps (an
    empty list is one). Other files are not parsed.
    """
    own = StructType.fromDDL(ANALYSIS)
    schema = keyed(own, keys).add("_corrupt", "string")
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    rows = reader.option("multiLine", multi_line).json(path).withColumn("file", F.col("_metadata.file_name"))
    if file_pattern:
        rows = rows.where(F.col("file").rlike(file_pattern))
    return _judged(rows, schema, own)


def _judged(rows: DataFrame, schema: StructType, own: StructType) -> tuple[DataFrame, DataFrame]:
    named = [F.col(k.name).cast(f.dataType).alias(f.name) for k, f in zip(schema, own, strict=False)]
    rows = rows.select(*named, "_corrupt", "file")
    reason = F.when(F.col("_corrupt").isNotNull(), "malformed")
    for name in ("ref", "spans", "steps"):
        reason = reason.when(F.col(name).isNull(), f"no {name}")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("_corrupt", "reason"), rows.where("reason is not null").select("file", "reason", "_corrupt")


def judged_documents(files: DataFrame, keys: dict[str, str] = PUBLISHED) -> tuple[DataFrame, DataFrame]:
    """As ``read_analyses``, of rows (file, value) that hold a document each."""
    own = StructType.fromDDL(ANALYSIS)
    schema = keyed(own, keys).add("_corrupt", "string")
    parsed = files.select("file", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    return _judged(parsed.select("file", "d.*"), schema, own)


def explode_analyses(analyses: DataFrame) -> dict[str, DataFrame]:
    """The tables units, spans, steps, phrases, terms, comments, comment_phrases and dependencies, keyed by ref."""
    steps = analyses.select("ref", F.explode("steps").alias("s"))
    of_step = [F.col("ref"), F.col("s.stepNumber").alias("stepNumber")]
    long = None
    for b in BUCKETS:
        part = steps.select(*of_step, F.lit(b).alias("bucket"), F.posexplode(f"s.comments.{b}").alias("pos", "c"))
        long = part if long is None else long.union(part)
    of_comment = ["ref", "stepNumber", "bucket", "pos"]
    return {
        "units": analyses.drop("spans", "steps"),
        "spans": analyses.select("ref", F.inline("spans")),
        "steps": steps.select(*of_step, *[F.col(f"s.{t}") for t in (*STEP_TEXTS, *LOGIC)], F.col("s.comments.together").alias("together")),
        "phrases": steps.select(*of_step, F.inline("s.phrases")),
        "terms": steps.select(*of_step, F.posexplode("s.keyTerms").alias("pos", "x")).select("ref", "stepNumber", "pos", "x.*"),
        "comments": long.select(*of_comment, "c.source", F.col("c.ref").alias("commentRef"), "c.text", "c.translation", "c.takeaway"),
        "comment_phrases": long.select(*of_comment, F.inline("c.phrases")),
        "dependencies": steps.select(*of_step, F.explode("s.dependsOn").alias("dependsOn")),
    }


def assemble_analyses(tables: dict[str, DataFrame]) -> DataFrame:
    """The nested documents of the tables that ``explode_analyses`` makes; arrays are in order of their numbers or places.

    Tables other than units, and columns that are missing, count as empty; a unit without rows of a table has an empty
    array of spans or steps and null below.
    """
    own = {f.name: f.dataType for f in StructType.fromDDL(ANALYSIS)}
    step, span = own["steps"].elementType, own["spans"].elementType
    comment = step["comments"].dataType["first"].dataType.elementType

    def struct_of(df: DataFrame, kind: StructType, renamed: dict[str, str] | None = None) -> Column:
        source = lambda f: (renamed or {}).get(f.name, f.name)
        has = lambda f: F.col(source(f)) if source(f) in df.columns else F.lit(None)
        return F.struct(*[has(f).cast(f.dataType).alias(f.name) for f in kind])

    def nested(df: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), value.alias("value"))), lambda a, b: a["_order"] - b["_order"])
        return df.groupBy(*by).agg(F.transform(pairs, lambda x: x["value"]).alias(name))

    keys = ["ref", "stepNumber"]
    steps = tables["steps"]
    if "phrases" in tables:
        steps = steps.join(nested(tables["phrases"], keys, "phraseNumber", struct_of(tables["phrases"], step["phrases"].dataType.elementType), "phrases"), keys, "left")
    if "terms" in tables:
        steps = steps.join(nested(tables["terms"], keys, "pos", struct_of(tables["terms"], step["keyTerms"].dataType.elementType), "keyTerms"), keys, "left")
    if "dependencies" in tables:
        steps = steps.join(tables["dependencies"].groupBy(*keys).agg(F.array_sort(F.collect_list("dependsOn")).alias("dependsOn")), keys, "left")
    if "comments" in tables:
        c = tables["comments"]
        if "comment_phrases" in tables:
            p, by = tables["comment_phrases"], [*keys, "bucket", "pos"]
            c = c.join(nested(p, by, "phraseNumber", struct_of(p, comment["phrases"].dataType.elementType), "phrases"), by, "left")
        c = c.withColumn("_value", struct_of(c, comment, {"ref": "commentRef"}))
        of_bucket = [F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.struct("pos", "_value"))), lambda x, y: x["pos"] - y["pos"]).alias(b) for b in BUCKETS]
        c = c.groupBy(*keys).agg(*of_bucket).select(*keys, *[F.transform(b, lambda x: x["_value"]).alias(b) for b in BUCKETS])
        together = F.col("together") if "together" in steps.columns else F.lit(None).cast("string")
        present = F.col("first").isNotNull() | together.isNotNull()
        steps = steps.join(c, keys, "left").withColumn("comments", F.when(present, F.struct(*BUCKETS, together.alias("together"))))
    none = lambda name: F.array().cast(own[name])
    units = tables["units"].join(nested(steps, ["ref"], "stepNumber", struct_of(steps, step), "steps"), "ref", "left")
    if "spans" in tables:
        units = units.join(nested(tables["spans"], ["ref"], "spanNumber", struct_of(tables["spans"], span), "spans"), "ref", "left")
    made = units.withColumns({n: F.coalesce(F.col(n), none(n)) if n in units.columns else none(n) for n in ("steps", "spans")})
    return made.select(*[c for c in own if c in made.columns])


def as_documents(analyses: DataFrame, keys: dict[str, str] = PUBLISHED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(carried columns, value: string): each analysis as a JSON document with the documents' keys; nulls are left out."""
    told = analyses.drop(*carry)
    kinds = keyed(told.schema, keys)
    columns = [F.col(c).cast(k.dataType).alias(k.name) for c, k in zip(told.columns, kinds, strict=True)]
    return analyses.select(*carry, F.to_json(F.struct(*columns)).alias("value"))


def write_analyses(analyses: DataFrame, path: str, keys: dict[str, str] = PUBLISHED) -> None:
    """One JSON document a line."""
    as_documents(analyses, keys).write.text(path)


FEEDBACK = "ts string, ref string, stepNumber int, field string, oldValue string, newValue string, userNote string, applied boolean, message string"


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The records of a log of JSON lines; bad lines are left out."""
    schema = StructType.fromDDL(FEEDBACK + ", _corrupt string")
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null and ref is not null").drop("_corrupt")


def append_feedback(records: DataFrame, path: str) -> None:
    records.select(F.to_json(F.struct(*records.columns)).alias("value")).write.mode("append").text(path)


def unwrapped(value: Column, kind: DataType, path: str = "$") -> Column:
    """The plain value of the typed wrapper (such as {"stringValue": "x"} or {"arrayValue": {"values": [...]}}) at ``path`` of a VARIANT.

    Wrappers may lie in maps and arrays to any depth that ``kind`` declares. Whole numbers may stand in for others; a
    nullValue, an absent field, or a wrapper of another kind give null. Values are read by their whole path from the nearest
    array element or map entry, so no level between is copied to a VARIANT of its own.
    """
    at = lambda step, ddl: F.try_variant_get(value, path + step, ddl)
    if isinstance(kind, StructType):
        fields = [unwrapped(value, f.dataType, f"{path}.mapValue.fields['{f.name}']").alias(f.name) for f in kind]
        return F.when(at(".mapValue", "variant").isNotNull(), F.struct(*fields))
    if isinstance(kind, MapType):
        entries = F.coalesce(at(".mapValue.fields", "map<string, variant>"), F.expr("cast(map() as map<string, variant>)"))
        return F.when(at(".mapValue", "variant").isNotNull(), F.transform_values(entries, lambda _, v: unwrapped(v, kind.valueType)))
    if isinstance(kind, ArrayType):
        values = F.coalesce(at(".arrayValue.values", "array<variant>"), F.expr("cast(array() as array<variant>)"))
        return F.when(at(".arrayValue", "variant").isNotNull(), F.transform(values, lambda x: unwrapped(x, kind.elementType)))
    number = at(".integerValue", "string")
    if isinstance(kind, FractionalType):
        return F.coalesce(at(".doubleValue", "string"), number).try_cast(kind)
    if isinstance(kind, IntegralType):
        return number.try_cast(kind)
    name = {"boolean": "booleanValue", "timestamp": "timestampValue", "date": "timestampValue"}.get(kind.typeName())
    if name is not None:
        return at(f".{name}", "string").try_cast(kind)
    return F.coalesce(at(".stringValue", "string"), at(".timestampValue", "string"))


def ingest_typed_export(rows: DataFrame, raw: str, fields: dict[str, str]) -> DataFrame:
    """Columns of typed-wrapper JSON documents {"fields": {name: {"...Value": ...}}}, for a declared schema of DDL kinds.

    Each document is parsed once, to a VARIANT, and unwrapped by ``unwrapped``. A malformed document gives nulls.
    """
    kinds = StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in fields.items()))
    parsed = rows.withColumn("_doc", F.try_parse_json(raw))
    plain = [unwrapped(F.col("_doc"), f.dataType, f"$.fields['{f.name}']").alias(f.name) for f in kinds]
    return parsed.select(*[c for c in rows.columns if c != raw], *plain)


_STRING = r'"(?:[^"\\]++|\\.)*+"'
_BRACKETS = re.compile(r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?\Z)|[{}\[\]]')
_QUOTES = re.compile(rf"(?s){_STRING}|[“”]([^“”]*+)[“”]|[“”]")
_COMMAS = re.compile(rf"(?s)({_STRING})|,\s*(?=[}}\]])")


def balanced(text: str, opener: str, closer: str) -> str | None:
    """The text from the first ``opener`` to the ``closer`` that balances it, brackets within JSON strings aside."""
    start, depth = text.find(opener), 0
    if start < 0:
        return None
    for token in _BRACKETS.finditer(text, start):
        depth += (token[0] == opener) - (token[0] == closer)
        if not depth:
            return text[start : token.end()]
    return None


def repaired_json(text: str) -> str:
    """Curly quotes become straight ones and trailing commas go, but not within strings; curly quotes make strings, too."""

    def straight(m: re.Match) -> str:
        if m[0][0] == '"':
            return m[0]
        return '"' if m[1] is None else '"' + m[1].replace('"', '\\"') + '"'

    return _COMMAS.sub(lambda m: m[1] or "", _QUOTES.sub(straight, text))


def answer_of(text: str | None) -> str | None:
    """The JSON list of an answer's objects, as ``ingest_model_output`` describes; null if there is none."""
    text = (text or "").strip()
    if text.startswith("```"):
        text = re.sub(r"\s*```\s*\Z", "", re.sub(r"(?i)\A```(?:json)?\s*", "", text))
    for repair in (lambda t: t, repaired_json):
        tried = repair(text)
        for choose in (lambda t: t, lambda t: balanced(t, "{", "}"), lambda t: balanced(t, "[", "]")):
            chosen = choose(tried)
            if not chosen or chosen[0] not in "{[":
                continue
            try:
                found = json.loads(chosen)
            except (ValueError, RecursionError):
                continue
            return json.dumps(found if isinstance(found, list) else [found], ensure_ascii=False)
    return None


_SLICE = 64


def ingest_model_output(rows: DataFrame, raw: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, quarantined): the JSON of raw answers, parsed by ``schema``; an array at top level gives a row an element.

    A code fence around the answer goes. The first of these that is JSON counts: the whole answer; its first balanced
    object, else array; then the same of the answer with curly quotes and trailing commas repaired outside strings.
    Objects that do not fit the schema, also one of an array, send the whole answer to quarantine with its text, as do
    answers without JSON and JSON that is neither object nor array. Of repeated keys the last counts. An empty array
    gives no rows. Strings are found by one pass over the text, in slices of Arrow batches, so that a worker holds few texts
    beside its batch; the schema is applied by Spark.
    """

    @F.arrow_udf("string")
    def answers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at in range(0, len(texts), _SLICE):
                yield pa.array([None if t is None else answer_of(t) for t in texts.slice(at, _SLICE).to_pylist()], pa.string())

    listed = F.concat(F.lit('{"answers": '), answers(F.col(raw)), F.lit("}"))
    kind = f"answers array<struct<{schema}>>, _corrupt string"
    options = {"columnNameOfCorruptRecord": "_corrupt"}
    parsed = rows.withColumn("_parsed", F.from_json(listed, kind, options))
    whole = F.col("_parsed._corrupt").isNull() & ~F.exists("_parsed.answers", lambda x: x.isNull())
    good = F.coalesce(F.col("_parsed").isNotNull() & whole, F.lit(False))
    keep = [c for c in rows.columns if c != raw]
    return parsed.where(good).select(*keep, F.inline("_parsed.answers")), parsed.where(~good).select(*keep, raw)
