"""Secret scans over a ledger of blobs: every content is scanned once for each version of each rule."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sliceweave.session import materialize


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched left to right without overlap; a match counts if ``group`` has ``least`` characters.

    ``hint`` matches wherever a counting match may lie, and is cheap to try first.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base kinds, in the order in which spans of one place are listed.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
BASE_KINDS = ("assign", "access", "hex")
# what this scanner adds
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 24, r"eyJ[A-Za-z0-9_-]+\.eyJ"),
)
ALL_RULES = RULES + MORE_RULES


def blob_of(text: Column) -> Column:
    """Content address; a null text is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class Ledger:
    """Two Parquet folders: which blob was scanned under which rules, and what was found.

    Findings are written before the scanned rows, so a job that dies between the two scans those blobs again; readers drop
    the repeats.
    """

    SCANNED, FOUND = "blob string, done array<string>", "blob string, rule string, start long, stop long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", self.SCANNED)

    def findings(self) -> DataFrame:
        return self._read("findings", self.FOUND).distinct()

    def update(self, versions: DataFrame, id_col: str, text_col: str, rules: Sequence[Rule]) -> None:
        """Scan what the ledger lacks: pairs of a blob among ``versions`` and a rule version.

        Ids and content addresses alone decide what is new. One row of each new blob is then fetched by its id, so that a
        text of a thousand copies moves once, and no group of copies meets in a task.
        """
        wanted = F.array(*[F.lit(r.name) for r in rules])
        new = versions.groupBy("blob").agg(F.min(id_col).alias("_first"))
        done = self.scanned().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("done"))).alias("_done"))
        new = new.join(done, "blob", "left").withColumn("_todo", F.array_except(wanted, F.coalesce("_done", F.array().cast("array<string>"))))
        new = materialize(new.filter(F.size("_todo") > 0).select("blob", "_first", "_todo"))
        texts = self._texts(versions, new, id_col, text_col)
        found = texts.select("blob", F.explode(F.array_compact(F.array(*[self._spans(r) for r in rules]))).alias("_r"))
        found = found.select("blob", F.col("_r.rule").alias("rule"), F.posexplode(F.arrays_zip("_r.gaps", "_r.hits")).alias("_i", "_m"))
        # rows alike in id and text have come along; they leave in the tasks that hold them, before anything is added up
        found = found.select("blob", "rule", "_i", F.col("_m.gaps").alias("_gap"), F.col("_m.hits").alias("_hit")).distinct()
        # a gap, a match, a gap, a match ...: starts are running sums within one blob and rule
        so_far = Window.partitionBy("blob", "rule").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        ends = F.sum(F.col("_gap") + F.coalesce(F.abs("_hit"), F.lit(0))).over(so_far)
        found = found.select("blob", "rule", ends.alias("stop"), F.col("_hit").cast("long").alias("_hit")).filter("_hit > 0")
        found = found.select("blob", "rule", (F.col("stop") - F.col("_hit")).alias("start"), "stop")
        found.write.mode("append").parquet(f"{self.folder}/findings")
        new.select("blob", F.col("_todo").alias("done")).write.mode("append").parquet(f"{self.folder}/scanned")

    @staticmethod
    def _texts(versions: DataFrame, new: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """The rows of each new blob that have its first id: one, or several if rows are alike in id and text."""
        right = new.select(F.col("blob").alias("_blob"), "_first", "_todo").hint("shuffle_hash")
        left = versions.select("blob", F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        return left.join(right, (left["blob"] == right["_blob"]) & left["_id"].eqNullSafe(right["_first"])).drop("_blob")

    @staticmethod
    def _spans(rule: Rule) -> Column:
        """Lengths of the gaps before matches, and of the matches: negative for those that do not count; null without a hit."""
        text, pattern = F.coalesce("_text", F.lit("")), F.lit(rule.pattern)
        hits = F.regexp_extract_all(text, pattern, F.lit(0))
        kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
        lengths = F.zip_with(hits, kept, lambda h, k: F.when(F.length(k) >= rule.least, F.length(h)).otherwise(-F.length(h)))
        gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
        spans = F.struct(F.lit(rule.name).alias("rule"), F.slice(gaps, 1, F.size(lengths)).alias("gaps"), lengths.alias("hits"))
        return F.when(F.array_contains("_todo", rule.name) & text.rlike(rule.hint), spans)


def scan(docs: DataFrame, ledger: Ledger, rules: Sequence[Rule] = ALL_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, blob, spans) of all documents: spans is an array of (kind, start, stop), by start and then rule, empty
    without findings. Offsets count code points; stop is exclusive.

    Ids stand for paths, and several rows of one id for its versions. New blobs are scanned and entered in the ledger, known
    ones are not read again; findings are joined back to every row by content. A null text is the empty blob. Null and
    repeated ids are kept as they are, an empty table gives no rows, other columns are not read.
    """
    versions = docs.select(F.col(id_col), F.col(text_col), blob_of(F.col(text_col)).alias("blob"))
    paths = materialize(versions.select(id_col, "blob"))
    ledger.update(versions, id_col, text_col, rules)
    place = {r.name: i for i, r in enumerate(rules)}
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col("rule"))
    found = ledger.findings().filter(F.col("rule").isin(list(place)))
    entry = F.struct("start", rank.alias("rank"), F.element_at(F.split("rule", "@"), 1).alias("kind"), "stop")
    per_blob = found.groupBy("blob").agg(F.array_sort(F.collect_list(entry)).alias("_found"))
    spans = F.transform("_found", lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["stop"].alias("stop")))
    per_blob = materialize(per_blob.select(F.col("blob").alias("_blob"), spans.alias("spans")))
    joined = paths.join(per_blob, paths["blob"] == per_blob["_blob"], "left")
    empty = F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>")
    return joined.select(id_col, "blob", F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame, ledger: Ledger, rules: Sequence[Rule] = ALL_RULES, mark: str = "[secret]", id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; texts without findings stay as they are.

    The ledger's spans are put together where they overlap, so a place that several rules find has one mark, and joined by
    content; each text is cut at them once. Only texts in which some rule's hint matches can have findings, so only those
    are shuffled. Null texts stay null, an empty table gives no rows, rows alike are masked alike, and other columns are
    kept, whatever their names.
    """
    from sliceweave.llm.common import as_rows, field

    scan(docs, ledger, rules, id_col, text_col)
    kept = ledger.findings().filter(F.col("rule").isin([r.name for r in rules]))
    # a span that begins before all earlier ones of its text have ended belongs to them
    ahead = Window.partitionBy("blob").orderBy("start", "stop")
    apart = (F.col("start") >= F.coalesce(F.max("stop").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int")
    runs = kept.withColumn("apart", apart).withColumn("run", F.sum("apart").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    cuts = runs.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))

    rows, text = as_rows(docs), field(text_col)
    hinted = F.coalesce(text, F.lit("")).rlike("|".join(f"(?:{r.hint})" for r in rules))
    met = rows.filter(hinted).withColumn("blob", blob_of(text)).join(materialize(cuts), "blob", "left")
    before = lambda i: F.coalesce(F.get("cuts", i - 1)["stop"], F.lit(0))
    part = lambda c, i: F.concat(text.substr((before(i) + 1).cast("int"), (c["start"] - before(i)).cast("int")), F.lit(mark))
    last = F.element_at("cuts", -1)["stop"]
    masked = F.concat(F.array_join(F.transform("cuts", part), ""), text.substr((last + 1).cast("int"), F.length(text)))
    changed = met.select(F.col("row").withField(f"`{text_col}`", F.when(F.col("cuts").isNull(), text).otherwise(masked)).alias("row"))
    return rows.filter(~hinted).unionByName(changed).select("row.*")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and listings of ``scan``: n_assign, n_access, n_hex, base_sha256, spans."""
    is_base = lambda s: s["kind"].isin(*BASE_KINDS)
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", is_base), line), ",")
    return found.select(F.col(id_col).alias("doc_id"), *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(base, 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", line), ",").alias("spans"), "blob")
