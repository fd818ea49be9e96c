"""Secret scans with an incremental ledger of blobs, in built-in functions only.

A blob is the content of a text, addressed by its SHA-256. The ledger holds a
row per blob and rule version that was ever scanned, with what was found. A scan
takes a history of texts (any number of versions per path), scans each distinct
blob once for each rule version the ledger lacks, and joins all findings back to
every row of the history. ``Ledger`` keeps the rows as a table under the shared
folder: ``update`` appends what a history adds, and findings and redaction read
them from there. A task run again writes its rows once (the table is committed
as a whole); two writers at a time may both add a pair, which counts once.

A content that many rows share is cut by a hash of the rows' other columns when
findings are joined back, so that no task takes them all.

Spans count code points, end exclusive. The places of the matches of a rule are
sums of the lengths of the matches and of the pieces between them.

Defined results: a null text is the empty blob; a blob without findings has a
ledger row with an empty list; repeated rows get the same findings; other columns
of the history pass through, and helper columns carry a prefix no table uses; an empty
history adds no row. Texts are scanned whole, however long; spans that start at
the same place are listed in the order of the rules.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from playframe.llm.common import shared_root, spread_join, text_of

P = "_s_"
FINDING = "array<struct<start:int,rank:int,kind:string,end:int>>"
ROWS = f"blob string, version string, findings {FINDING}"
KEPT = "playframe.secrets.ledger"   # session setting: folder of a ledger that outlives the run
MARK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0   # the group whose length counts
    least: int = 1   # code points it has at least


# fixed values: the base rules of the contract
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)
VERSIONS = {"base-1": BASE, "extra-1": EXTRA}
RANK = {r.kind: i for i, r in enumerate((*BASE, *EXTRA))}


def _search(rule: Rule) -> str:
    """A pattern with the same surviving matches. Runs of one class that are the
    whole match can ask for their length at once: a failing run is never part of
    a longer one."""
    if rule.kind == "hex":
        return f"[0-9a-f]{{{rule.least},}}"
    if rule.kind == "access":
        return f"AKIA[A-Z0-9]{{{rule.least - 4},}}"
    return rule.pattern


def content(text: Column) -> Column:
    return F.sha2(text, 256)


def matches_of(blobs: DataFrame) -> DataFrame:
    """A row per surviving match of the rule versions each blob lacks: blob,
    version, rank, kind, start, end. Every rule runs in one pass over the blobs."""
    text, seen = F.col(f"{P}text"), F.col(f"{P}seen")
    rules = [(v, r) for v, some in VERSIONS.items() for r in some]
    df = blobs.withColumns({
        f"{P}m{i}": F.when(~F.array_contains(seen, v), F.regexp_extract_all(text, F.lit(_search(r)), F.lit(0)))
        for i, (v, r) in enumerate(rules)})
    total = sum((F.coalesce(F.size(f"{P}m{i}"), F.lit(0)) for i in range(len(rules))), F.lit(0))
    df = df.filter(total > 0)
    sizes = []
    for i, (v, r) in enumerate(rules):
        m = F.col(f"{P}m{i}")
        groups = m if r.group == 0 else F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group))
        between = F.split(text, _search(r), -1)
        sizes.append(F.when(F.size(m) > 0, F.struct(
            F.lit(v).alias("version"), F.lit(RANK[r.kind]).alias("rank"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"),
            F.arrays_zip(F.transform(m, F.length).alias("size"), F.transform(groups, F.length).alias("counted"),
                         F.slice(F.transform(between, F.length), F.lit(1), F.size(m)).alias("before")).alias("at"))))
    rows = df.select(f"{P}blob", F.explode(F.filter(F.array(*sizes), lambda x: x.isNotNull())).alias("r"))
    rows = rows.select(f"{P}blob", F.col("r.version").alias(f"{P}version"), "r.rank", "r.kind", "r.least", F.posexplode("r.at").alias("i", "m"))
    order = Window.partitionBy(f"{P}blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.before") + F.col("m.size")).over(order)
    return (rows.withColumn("end", end.cast("int")).filter(F.col("m.counted") >= F.col("least"))
            .select(f"{P}blob", f"{P}version", "rank", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end"))


def blobs_of(history: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Distinct contents with the rule versions the ledger has for them; those
    it has for every version are left out."""
    text = text_of()
    blobs = history.select(content(text).alias(f"{P}blob"), text.alias(f"{P}text"))
    if ledger is None:
        return blobs.dropDuplicates([f"{P}blob"]).withColumn(f"{P}seen", F.array().cast("array<string>"))
    seen = ledger.groupBy(F.col("blob").alias(f"{P}blob")).agg(F.collect_set("version").alias(f"{P}seen"))
    done = F.size(F.array_intersect(F.col(f"{P}seen"), F.array(*map(F.lit, VERSIONS)))) >= len(VERSIONS)
    known = seen.filter(done).select(f"{P}blob")
    fresh = blobs.join(known, f"{P}blob", "left_anti").dropDuplicates([f"{P}blob"])
    return fresh.join(seen, f"{P}blob", "left").withColumn(f"{P}seen", F.coalesce(f"{P}seen", F.array().cast("array<string>")))


def scan(history: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows to add: blob, version, findings, for each unseen pair."""
    blobs = blobs_of(history, ledger)
    pairs = blobs.select(f"{P}blob", F.explode(F.filter(
        F.array(*map(F.lit, VERSIONS)), lambda v: ~F.array_contains(F.col(f"{P}seen"), v))).alias(f"{P}version"))
    found = matches_of(blobs).groupBy(f"{P}blob", f"{P}version").agg(_listed())
    return pairs.join(found, [f"{P}blob", f"{P}version"], "left").select(
        F.col(f"{P}blob").alias("blob"), F.col(f"{P}version").alias("version"),
        F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def _listed() -> Column:
    return F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).cast(FINDING).alias("findings")


class Ledger:
    """Ledger rows as a Parquet table that only grows. Its folder is ``path``,
    else the one the session names, else a new one under the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or spark.conf.get(KEPT, None) or f"{shared_root(spark)}/secrets-{uuid.uuid4().hex}"

    def rows(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(ROWS).parquet(self.path)
        return self.spark.createDataFrame([], ROWS)

    def update(self, history: DataFrame) -> DataFrame:
        """Scan the contents of ``history`` under the rule versions the ledger
        lacks for them, append the rows, and give all rows."""
        known = self.rows()
        scan(history, None if known.isEmpty() else known).write.mode("append").parquet(self.path)
        return self.rows()


def _found(history: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """Findings of the contents of ``history``, a row each; the contents that
    the ledger lacks are scanned here."""
    return matches_of(blobs_of(history, ledger)).select(f"{P}blob", "start", "rank", "kind", "end")


def _recorded(ledger: DataFrame) -> DataFrame:
    """Findings in the ledger, a row each; those of a blob and version once."""
    some = ledger.filter(F.col("version").isin(*VERSIONS) & (F.size("findings") > 0)).dropDuplicates(["blob", "version"])
    return some.select(F.col("blob").alias(f"{P}blob"), F.explode("findings").alias("f")).select(
        f"{P}blob", "f.start", "f.rank", "f.kind", "f.end")


def _others(history: DataFrame) -> list[str]:
    """The columns that tell rows of equal content apart."""
    return [c for c in history.columns if c != "text"] or [f"{P}blob"]


def findings(history: DataFrame, ledger: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """The history with the findings of each row, from the ledger and from
    scanning what it lacks; without a ledger, from scanning alone. A ledger that
    was updated with this history is ``complete``: no text is read for it."""
    if ledger is None:
        found = _found(history, None)
    else:
        found = _recorded(ledger) if complete else _found(history, ledger).union(_recorded(ledger))
    per_blob = found.groupBy(f"{P}blob").agg(_listed().alias(f"{P}findings"))
    rows = history.withColumn(f"{P}blob", content(text_of()))
    joined = spread_join(rows, per_blob, f"{P}blob", _others(history))
    return joined.select(*history.columns, F.coalesce(f"{P}findings", F.array().cast(FINDING)).alias("findings"))


def joined(spans: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` with every finding in its text replaced by a mark and n_chars
    set to the new length; texts without findings stay as they are. ``ledger``
    has been updated with these texts; without one they are scanned."""
    found = _found(docs, None) if ledger is None else _recorded(ledger)
    order = Window.partitionBy(f"{P}blob").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.withColumn("last", F.coalesce(F.max("end").over(order), F.lit(0))).filter("end > last")
    cuts = spans.groupBy(f"{P}blob").agg(F.sort_array(F.collect_list(F.struct("end", "last", "start"))).alias(f"{P}cuts"))
    rows = spread_join(docs.withColumn(f"{P}blob", content(text_of())), cuts, f"{P}blob", _others(docs))
    c = F.col(f"{P}cuts")
    pieces = F.transform(c, lambda x: F.when(x["start"] < x["last"], F.lit("")).otherwise(
        F.concat(F.substring("text", x["last"] + 1, x["start"] - x["last"]), F.lit(MARK))))
    tail = F.substring("text", F.element_at(c, -1)["end"] + 1, F.length("text"))
    rows = rows.withColumn(f"{P}clean", F.when(c.isNotNull(), F.concat(F.array_join(pieces, ""), tail)))
    new = {"text": F.coalesce(f"{P}clean", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(f"{P}clean").isNull(), F.col("n_chars")).otherwise(
            F.length(f"{P}clean").cast(docs.schema["n_chars"].dataType))
    return rows.withColumns(new).select(*docs.columns)
