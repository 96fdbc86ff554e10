"""Secret scans by corpus-wide ownership frequency, with DataFrame functions only.

Candidates come from three patterns. Hashes of their values are counted by distinct texts and by distinct owners (the source
of a text) over the whole corpus; copies of one text are one text of one owner, the least of theirs, so that copying a document
neither hides a credential nor makes an owner of who copies it. A value that many owners hold, or that one owner has in many
texts, is a copied example; one that is rare in both ways and looks random is a live credential. Live values are reported as
spans of a kind of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.session import save


#: Kinds in the order in which spans with equal starts are listed; `live` is what ownership adds.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a least length in the pattern drops the same matches as a test afterwards.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6


def _found(text: Column, pattern: str, group: int) -> Column:
    """array of (gap before the match, match, value), in code points and in order."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gap = F.transform(F.split(text, pattern, -1), F.length)
    return F.when(text.rlike(pattern), F.arrays_zip(F.slice(gap, 1, F.size(match)).alias("gap"), F.transform(match, F.length).alias("size"), value.alias("value"))).otherwise(F.array().cast("array<struct<gap:int,size:int,value:string>>"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(every row of docs: row, id), (every candidate: row, id, owner, key of the text, kind as index, start, end, value start, value).

    A null text is empty. A null owner is one owner of its own. Repeated rows are scanned each."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("")) if owner_col in docs.columns else F.lit("")
    scanned = save(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            owner.alias("owner"),
            F.when(text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX), F.sha2(text, 256)).alias("text_key"),
            F.array(_found(text, ASSIGN, 2), _found(text, ACCESS, 0), _found(text, HEX, 0)).alias("found"),
        ),
        "secrets-scan",
    )
    each = scanned.where("size(found[0]) + size(found[1]) + size(found[2]) > 0").select("row", "id", "owner", "text_key", F.posexplode("found").alias("kind", "list")).select("row", "id", "owner", "text_key", "kind", F.posexplode("list").alias("nr", "m"))
    order = Window.partitionBy("row", "kind").orderBy("nr")
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(order)
    spans = each.select("row", "id", "owner", "text_key", "kind", end.alias("end"), F.col("m.size").alias("size"), F.col("m.value").alias("value")).where(F.length("value") >= LEAST_VALUE)
    return scanned.select("row", "id"), spans.select("row", "id", "owner", "text_key", "kind", (F.col("end") - F.col("size")).alias("start"), "end", (F.col("end") - F.length("value")).alias("value_start"), "value")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, documents, owners) of every candidate value: distinct texts that hold it, and owners of those. Counts are made by
    (value, text), then by (value, owner), so that a value in a third of all documents is summed on the side that reads it."""
    by_text = spans.select(F.sha2("value", 256).alias("hash"), "owner", "text_key").groupBy("hash", "text_key").agg(F.min("owner").alias("owner"))
    by_owner = by_text.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("documents"))
    return by_owner.groupBy("hash").agg(F.sum("documents").alias("documents"), F.count(F.lit(1)).alias("owners"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", most_owners: int = 2, most_documents: int = 10, least_symbols: int = 6, least_length: int = 12) -> DataFrame:
    """One row for each row of docs: row, id, spans = array of (start, kind as index into KINDS, end), sorted, n_examples.

    live: a value that at most `most_owners` owners hold, in at most `most_documents` different texts, of `least_length` or more
    characters with `least_symbols` different ones at least. n_examples: candidates whose value more owners or texts hold. Offsets count code points, ends are exclusive. Rows without a match have an empty array. No rows in,
    none out. Other columns of docs are not read."""
    rows, spans = candidates(docs, id_col, text_col, owner_col)
    spans = save(spans.withColumn("hash", F.sha2("value", 256)), "secrets-spans")
    owned = save(ownership(spans), "secrets-owners")
    symbols = F.size(F.array_distinct(F.split("value", "")))
    example = (F.col("owners") > most_owners) | (F.col("documents") > most_documents)
    live = ~example & (F.length("value") >= least_length) & (symbols >= least_symbols)
    judged = spans.join(owned, "hash").select("row", "kind", "start", "end", "value_start", live.alias("live"), example.alias("example"))
    span = lambda start, kind, end: F.struct(F.col(start).alias("start"), kind.alias("kind"), F.col(end).alias("end"))
    both = F.array_compact(F.array(span("start", F.col("kind"), "end"), F.when(F.col("live"), span("value_start", F.lit(3), "end"))))
    by_row = judged.select("row", F.explode(both).alias("span"), F.col("example").cast("int").alias("example")).groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.sum(F.when(F.col("span.kind") < 3, F.col("example"))).alias("n_examples"))
    return rows.join(by_row, "row", "left").select("row", "id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"), F.coalesce("n_examples", F.lit(0)).alias("n_examples"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mask: str = "<secret>", **limits) -> DataFrame:
    """docs with each live value replaced by `mask`; overlapping ones become one mask. Columns as in docs; null texts stay null.

    Rows are matched by their text and id, as equal rows have equal spans."""
    text_or_none = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("")) if owner_col in docs.columns else F.lit("")
    key = F.sha2(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.sha2(text_or_none, 256), owner), 256)
    suspect = text_or_none.rlike(ASSIGN) | text_or_none.rlike(ACCESS) | text_or_none.rlike(HEX)
    keyed = save(docs.withColumns({"_redact_key": key, "_suspect": suspect}), "secrets-docs")
    # only texts with a candidate are scanned and dealt out again; all others pass where they are
    own = keyed.where("_suspect").select(F.col("_redact_key").alias("_key_as_id"), F.col(text_col).alias("_text"), owner.alias("_owner"))
    found = scan(own, "_key_as_id", "_text", "_owner", **limits)
    live = F.filter("spans", lambda s: s["kind"] == 3)
    hits = save(found.select(F.col("id").alias("_redact_key"), live.alias("_live")).where(F.size("_live") > 0).dropDuplicates(["_redact_key"]), "secrets-live")
    # spans are sorted by start: fold them into pieces of text, keeping how far the text is used up
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.when(fresh, F.concat(acc["out"], F.array(piece, F.lit(mask)))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    clean = F.aggregate("_live", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    masked = keyed.where("_suspect").join(hits, "_redact_key", "left").withColumn(text_col, F.when(F.col("_live").isNull(), text).otherwise(clean))
    return keyed.where("not _suspect").select(docs.columns).union(masked.select(docs.columns))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: base spans by kind and digest, all spans as text, for every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *[of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.col("n_examples").cast("long").alias("n_examples"),
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def _sql_found(kind: int, pattern: str, group: int) -> str:
    p = pattern.replace("'", "''").replace("(?i:password|passwd|secret|token|api_?key)", "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]")
    return f"""SELECT doc_id, source, txt, {kind} AS kind, CAST(list_sum(list_transform(gap[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[1:i-1], lambda g: length(g))), 0) AS BIGINT) AS s, length(m[i]) AS size, v[i] AS value
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, coalesce(source, '') AS source, sha256(coalesce(text, '')) AS txt, regexp_extract_all(coalesce(text, ''), '{p}', 0) AS m, regexp_extract_all(coalesce(text, ''), '{p}', {group}) AS v, string_split_regex(coalesce(text, ''), '{p}') AS gap FROM documents))"""


ORACLE = f"""WITH raw AS ({" UNION ALL ".join(_sql_found(*x) for x in ((0, ASSIGN, 2), (1, ACCESS, 0), (2, HEX, 0)))}),
spans AS (SELECT doc_id, source, txt, kind, s, s + size AS e, s + size - length(value) AS vs, value FROM raw WHERE length(value) >= {LEAST_VALUE}),
owned AS (SELECT value, count(DISTINCT source) AS owners, count(*) AS texts FROM (SELECT value, txt, min(source) AS source FROM spans GROUP BY value, txt) GROUP BY value),
judged AS (SELECT spans.*, owners > 2 OR texts > 10 AS example, owners <= 2 AND texts <= 10 AND length(spans.value) >= 12 AND len(list_distinct(string_split(spans.value, ''))) >= 6 AS live FROM spans JOIN owned USING (value)),
every AS (SELECT doc_id, kind, s, e FROM judged UNION SELECT doc_id, 3, vs, e FROM judged WHERE live),
named AS (SELECT doc_id, kind, s, e, concat_ws(':', ['assign', 'access', 'hex', 'live'][kind + 1], s, e) AS t FROM every),
listed AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_live,
 coalesce(string_agg(t, ',' ORDER BY s, kind, e) FILTER (kind < 3), '') AS base, string_agg(t, ',' ORDER BY s, kind, e) AS spans FROM named GROUP BY doc_id),
examples AS (SELECT doc_id, count(*) FILTER (example) AS n_examples FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN examples USING (doc_id)"""
