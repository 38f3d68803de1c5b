"""Secrets in texts, with an incremental ledger of content-addressed blobs.

Every historical version of a file is a blob named by its SHA-256. The ledger records, for a rule
version, which blobs were scanned and what was found. A scan reads only blobs that the ledger lacks
for the present rules (one row of each, however many paths hold it), appends its findings, and joins
them back to all paths. Built-in functions only. Null texts count as empty; repeated rows give
repeated results; an empty table gives an empty one; other columns are ignored.

At scale: the ledger and the owner choice shuffle digests and ids, never texts. A text that the ledger
lacks and no other path holds is scanned where it is read; only the texts of unseen blobs that several
paths hold move, in the row of their owner. Filters sized by the number of blobs, to a bound, tell these
apart; what a filter passes wrongly meets the owners in a join, so no result depends on it, and an update
without news moves no text. A blob that a third of all paths share is one row in the scan, and the
join back to paths is a plain equi-join whose hot partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import spans as S
from tessella.llm import storage

# The base patterns (possessive, so that no walk turns back).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
BASE = ("assign", "access", "hex")
# A key's block up to its last line; where that is missing, the lines of base64 that follow (also with breaks written as \n).
KEY = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:(?:\s|\\[rn])*+[A-Za-z0-9+/]{16,}+={0,2}+)*+(?:(?:\s|\\[rn])*+[A-Za-z0-9+/]++={1,2}+)?+)"
#: Further kinds: well-known key formats.
KINDS = {
    "assign": ASSIGN,
    "access": ACCESS,
    "hex": HEX,
    "github": r"(?<![A-Za-z0-9])gh[opsur]_[A-Za-z0-9]{36,}+",
    "slack": r"(?<![A-Za-z0-9])xox[abprs]-[0-9A-Za-z-]{20,}+",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+",
    "private_key": KEY,
}
#: Text that every match of a kind holds; a text without it is not walked for that kind.
NEEDS = {"access": "AKIA", "github": "gh", "slack": "xox", "jwt": "eyJ", "private_key": "-----BEGIN "}
RULES = "1.1"
FINDING = "array<struct<kind:string,start:int,end:int>>"


def scan_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `findings`: (kind, start, end) by start, then kind as listed."""
    kept = df.columns
    none = F.array().cast("array<string>")
    t = F.col(text_col)
    df = df.withColumns({f"__m_{k}": F.when(F.contains(t, F.lit(NEEDS[k])), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) if k in NEEDS else F.regexp_extract_all(t, F.lit(p), F.lit(0)) for k, p in KINDS.items()})
    df = df.withColumns({f"__p_{k}": S.pieces(t, p, F.col(f"__m_{k}")) for k, p in KINDS.items()})
    df = df.withColumns({f"__s_{k}": S.located(F.col(f"__m_{k}"), F.col(f"__p_{k}"), k) for k in KINDS})

    def ok(k: str, s: Column) -> Column:
        if k == "assign":
            return F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 8
        return F.length(s["value"]) >= 16 if k == "access" else F.lit(True)

    def ranked(i: int, s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(i).alias("i"), s["end"].alias("end"), s["kind"].alias("kind"))

    every = F.concat(*[
        F.transform(F.filter(f"__s_{k}", S.bound(ok, k)), S.bound(ranked, i))
        for i, k in enumerate(KINDS)
    ])
    ordered = F.transform(F.array_sort(every), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return df.select(*kept, ordered.cast(FINDING).alias("findings"))


class Ledger:
    """Table (blob, rules, findings) in a shared folder; appended to, never rewritten."""

    def __init__(self, spark, folder: str | None = None, rules: str = RULES):
        self.spark, self.rules = spark, rules
        self.folder = folder or storage.work_folder(spark, "ledger")

    def rows(self) -> DataFrame:
        schema = f"blob string, rules string, findings {FINDING}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.folder).where(F.col("rules") == self.rules)

    def update(self, versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
        """Scan what the ledger lacks of versions (path, text); returns (path, blob) of all of them.

        Each unseen blob is scanned in the row of its smallest path; a null path is the largest.
        """
        named = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
        paths = storage.cut(named.select("path", "blob"), "paths")
        blobs = paths.groupBy("blob").agg(F.min("path").alias("path"), F.count("*").alias("n"))
        blobs = storage.cut(blobs.join(self.rows().select("blob", F.lit(True).alias("seen")), "blob", "left"), "blobs")
        unseen, odd = blobs.where("seen IS NULL"), blobs.where("seen OR n > 1")
        is_unseen, is_odd = (storage.Told(df.select(F.xxhash64("blob").alias("h")), "h") for df in (unseen, odd))
        maybe = named.where(is_unseen.of(F.xxhash64("blob")))
        # No other path holds a text that the second filter doesn't: it is scanned in place.
        alone = maybe.where(~is_odd.of(F.xxhash64("blob"))).select("blob", "text")
        owned = maybe.where(is_odd.of(F.xxhash64("blob")))
        owned = owned.join(unseen.select("blob", "path").hint("shuffle_hash"), owned["path"].eqNullSafe(unseen["path"]) & (owned["blob"] == unseen["blob"]), "left_semi")
        # A path that is listed twice with one text gives its blob twice.
        owned = owned.select("blob", "text").dropDuplicates(["blob"])
        scan_texts(alone.unionByName(owned)).select("blob", F.lit(self.rules).alias("rules"), "findings").write.mode("append").parquet(self.folder)
        return paths


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """(id, blob, findings) for every row; findings come from the ledger, which is brought up to date first."""
    ledger = ledger or Ledger(docs.sparkSession)
    paths = ledger.update(docs, id_col, text_col)
    return paths.join(ledger.rows().select("blob", "findings"), "blob").select(F.col("path").alias("doc_id"), "blob", "findings")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """The query's columns: base counts, hash of the base spans, all spans."""
    df = find_secrets(docs)
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))
    return df.select(
        "doc_id",
        *[F.size(F.filter("findings", S.bound(S.is_kind, k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.concat_ws(",", S.as_text(base)), 256).alias("base_sha256"),
        F.concat_ws(",", S.as_text(F.col("findings"))).alias("spans"),
    )


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """docs, all rows and columns, with secrets replaced in the text. Findings meet their rows by blob; rows that a filter tells hold none stay where they are."""
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.update(docs, id_col, text_col)
    named = docs.withColumn("__blob", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    hits = storage.cut(ledger.rows().where(F.size("findings") > 0).select(F.col("blob").alias("__hit"), F.col("findings").alias("__found")), "hits")
    told = storage.Told(hits.select(F.xxhash64("__hit").alias("h")), "h").of(F.xxhash64("__blob"))
    met = named.where(told).join(hits.hint("shuffle_hash"), F.col("__blob") == F.col("__hit"), "left")
    safe = F.when(F.col("__found").isNull(), F.col(text_col)).otherwise(replaced(F.col(text_col), F.col("__found")))
    return named.where(~told).select(*docs.columns).unionByName(met.withColumn(text_col, safe).select(*docs.columns))


def replaced(text: Column, found: Column) -> Column:
    """Text with found spans, sorted by start or not, replaced by <kind>; overlapping ones become one."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        add = F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(add))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(ordered, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)
