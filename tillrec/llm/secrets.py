"""Secret scans with an incremental blob ledger (DataFrame operations only).

Every version of a text is content-addressed: its blob id is the SHA-256 of its UTF-8 form. The ledger
says which (blob, rule, rule version) triples have been scanned; a run scans each blob that lacks one of them once,
however many paths or versions hold it, and only for the rules it lacks. Findings belong to blobs and are joined back to all
paths. ``Ledger`` keeps both in a folder: each run appends what it scanned (a partition ``run``, findings before ledger,
so a run that broke off is not counted and is written anew), and later runs scan only what is missing. Findings name
their rule and its version; a listing takes only those of the rules as they are now.

Where a rule matches is computed without UDFs: ``split`` gives the texts between the matches and
``regexp_extract_all`` the matches, both leftmost and non-overlapping; a running sum of their lengths
in code points is the offset. Only blobs that match at all reach that step, a few narrow rows each.
Copies are collapsed by partial aggregation before the shuffle, and AQE splits the join of a blob with very many paths.

Rules: the base kinds assign, access and hex, then further token formats. A match whose value is too
short is dropped, without a retry inside it.

Defined cases: null text counts as the empty blob; null or repeated doc_ids give one row per input row;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillrec.llm import common


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    version: int = 1
    group: int = 0              # the group whose length counts
    min_chars: int = 1

    @property
    def label(self) -> str:
        return f"{self.kind}@{self.version}"


# the runs of the access and hex rules are greedy, so "at least" in the pattern finds the same matches as a later check
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, min_chars=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE_KINDS = 3
LEDGER = "blob_id string, rules array<string>"
FINDINGS = "blob_id string, rule string, kind_no int, begin long, finish long"


@dataclass(frozen=True)
class Scan:
    """``ledger``: blob_id and the rules scanned; ``findings``: one row per secret of a blob; what this
    run added to them."""
    ledger: DataFrame
    findings: DataFrame
    new_ledger: DataFrame
    new_findings: DataFrame


def addressed(versions: DataFrame) -> DataFrame:
    """Versions with their blob id; null text is the empty blob."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return versions.withColumn("text", text).withColumn("blob_id", F.sha2(text, 256))


def _matches(rule: Rule, number: int) -> Column:
    """A rule's matches of ``text`` in order: how many code points lie before each, and its own."""
    found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    between = F.split("text", rule.pattern, -1)
    value = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    each = F.transform(F.arrays_zip(found.alias("found"), F.slice(between, 1, F.size(found)).alias("between"), value.alias("value")),
                       lambda m, i: F.struct(F.lit(rule.label).alias("rule"), F.lit(number).alias("kind_no"), i.alias("nth"),
                                             F.char_length(m["between"]).alias("before"), F.char_length(m["found"]).alias("chars"),
                                             (F.char_length(m["value"]) >= rule.min_chars).alias("long_enough")))
    lacks = F.col("done").isNull() | ~F.array_contains("done", rule.label)
    return F.when(lacks & F.col("text").rlike(rule.pattern), each)


def scan(versions: DataFrame, earlier: Scan | None = None, rules: tuple[Rule, ...] = RULES) -> Scan:
    """Scan the blobs of ``versions`` (column ``text``) for the rules not yet in the ledger."""
    labels = F.array(*[F.lit(r.label) for r in rules])
    blobs = addressed(versions.select("text"))
    if earlier is not None:
        complete = earlier.ledger.filter(F.size(F.array_except(labels, "rules")) == 0)
        blobs = blobs.join(complete.select("blob_id"), "blob_id", "left_anti")
    blobs = blobs.select("blob_id", "text").dropDuplicates()
    if earlier is not None:
        blobs = blobs.join(earlier.ledger.select("blob_id", F.col("rules").alias("done")), "blob_id", "left")
    else:
        blobs = blobs.withColumn("done", F.lit(None).cast("array<string>"))
    hits = F.array_compact(F.array(*[_matches(r, n) for n, r in enumerate(rules)]))
    rows = blobs.select("blob_id", F.explode(F.flatten(hits)).alias("m")).select("blob_id", "m.*")
    up_to = Window.partitionBy("blob_id", "kind_no").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    finish = F.sum(F.col("before") + F.col("chars")).over(up_to)
    findings = new_findings = common.stored(
        rows.withColumn("finish", finish).filter("long_enough")
        .select("blob_id", "rule", "kind_no", (F.col("finish") - F.col("chars")).alias("begin"), "finish"), "secret-findings")
    ledger = new_ledger = addressed(versions.select("text")).select("blob_id").distinct().withColumn("rules", labels)
    if earlier is not None:
        new_ledger = new_ledger.join(earlier.ledger.select("blob_id", F.col("rules").alias("done")), "blob_id", "left") \
            .select("blob_id", F.array_except("rules", F.coalesce("done", F.array().cast("array<string>"))).alias("rules")) \
            .filter(F.size("rules") > 0)
        findings = earlier.findings.unionByName(findings)
        ledger = _by_blob(earlier.ledger.unionByName(new_ledger))
    return Scan(ledger, findings, new_ledger, new_findings)


def _by_blob(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("blob_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("rules")))).alias("rules"))


class Ledger:
    """Ledger and findings of all runs so far, in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Ledger:
        """A new ledger without any runs."""
        for part, fields in (("findings", FINDINGS), ("ledger", LEDGER)):
            spark.createDataFrame([], fields).write.parquet(f"{path}/{part}/run=0")
        return cls(spark, path)

    def _read(self, part: str, fields: str) -> DataFrame:
        return self.spark.read.schema(f"{fields}, run int").parquet(f"{self.path}/{part}")

    def last_run(self) -> int:
        return self._read("ledger", LEDGER).agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]

    def so_far(self) -> Scan:
        """All that the complete runs scanned and found."""
        ledger = self._read("ledger", LEDGER).drop("run")
        findings = self._read("findings", FINDINGS).filter(F.col("run") <= self.last_run()).drop("run")
        return Scan(_by_blob(ledger), findings, ledger.limit(0), findings.limit(0))

    def add(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what the ledger lacks of ``versions`` (column ``text``) and append it as a run."""
        last = self.last_run()
        found = scan(versions, self.so_far() if last else None, rules)
        found.new_findings.write.mode("overwrite").parquet(f"{self.path}/findings/run={last + 1}")
        found.new_ledger.write.mode("overwrite").parquet(f"{self.path}/ledger/run={last + 1}")


def _listed(found: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", F.get(kinds, x["kind_no"]), x["begin"].cast("string"), x["finish"].cast("string"))), ",")


def by_path(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts and digest of the base kinds (the first rules), and all spans, for every row of (doc_id, blob_id), by
    the rules as given: findings of their other versions don't count."""
    count = lambda n: F.count(F.when(F.col("kind_no") == n, 1))
    place = F.array_position(F.array(*[F.lit(r.label) for r in rules]), F.col("rule")).cast("int") - 1
    blobs = findings.withColumn("kind_no", place).filter("kind_no >= 0").groupBy("blob_id").agg(
        *[count(n).alias(f"n_{rules[n].kind}") for n in range(BASE_KINDS)],
        F.sort_array(F.collect_list(F.struct("begin", "kind_no", "finish"))).alias("found"))
    blobs = blobs.withColumn("spans", _listed(F.col("found"), rules)) \
        .withColumn("base", _listed(F.filter("found", lambda x: x["kind_no"] < BASE_KINDS), rules)).drop("found")
    joined = paths.join(blobs, "blob_id", "left")
    return joined.select("doc_id", *[F.coalesce(f"n_{rules[n].kind}", F.lit(0)).alias(f"n_{rules[n].kind}") for n in range(BASE_KINDS)],
                         F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
                         F.coalesce("spans", F.lit("")).alias("spans"), "blob_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    ledger = Ledger.create(spark, common.shared_path(spark, "secret-ledger"))
    ledger.add(docs)
    return by_path(addressed(docs).select("doc_id", "blob_id"), ledger.so_far().findings)


def _oracle() -> str:
    """DuckDB SQL; the patterns are written out here again."""
    kinds = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
        ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1), ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
        ("google", r"AIza[A-Za-z0-9_-]{35,}", 0, 1),
        ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
        ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    ]
    each = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS k, '{kind}' AS kind, unnest(string_split_regex(t, '{p}')) AS gap, "
        f"unnest(regexp_extract_all(t, '{p}', 0)) AS hit, unnest(regexp_extract_all(t, '{p}', {g})) AS val, "
        f"unnest(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1)) AS i, {least} AS least FROM d "
        f"WHERE regexp_matches(t, '{p}')" for n, (kind, p, g, least) in enumerate(kinds))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({each}),
s AS (SELECT doc_id, k, kind, val, least, length(hit) AS n,
             sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS finish FROM m WHERE hit IS NOT NULL),
f AS (SELECT doc_id, k, finish - n AS begin, kind || ':' || (finish - n)::BIGINT || ':' || finish::BIGINT AS span FROM s WHERE length(val) >= least),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(span, ',' ORDER BY begin, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY begin, k) AS spans
      FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       sha256(t) AS blob_id
FROM d LEFT JOIN g USING (doc_id)
"""


OP8_SQL = _oracle()
