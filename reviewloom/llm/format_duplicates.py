"""Records that are equal but for white space, letter case, punctuation or field order.

Each record is a multiset of normalised parts: the `name: value` pairs of a record line, or the whole text. Every part is
hashed, and the hashes are summed, so that the order of the parts leaves no trace and nothing has to be sorted. Records are
grouped by these sums, 128 bits in all, in rows of fixed size; only records of groups of several ids then bring their parts,
once, and each is compared part by part with the group's first record. Groups that hold many rows are salted, and their
first record is copied to every salt. Records that share all bits but not the parts are grouped by the parts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.sources.tables import materialize, scratch

#: Modulus of the summed hashes, a prime below 2 ** 61, so that sums never overflow a long.
MODULUS = (1 << 61) - 1
#: Rows of a group from which it is spread over several tasks.
HOT_ROWS = 200_000
#: Groups that are spread at most; the bound of rows per group rises with the table, so that no more can exceed it.
MAX_HOT = 2_000


def normalized(text: Column) -> Column:
    """Letters in lower case, digits, and a point or comma directly between two digits; nothing else."""
    return F.regexp_replace(F.lower(text), r"(?<!\p{N})[.,]|[.,](?!\p{N})|[^\p{L}\p{N}.,]+", "")


def parts(text: Column) -> Column:
    """Normalised parts of a record: of a line of `label: value` parts each part, otherwise the text as a whole."""
    pieces = F.filter(F.split(text, "[;|]"), lambda p: p.rlike(r"\S"))
    fields = (F.size(pieces) > 1) & F.forall(pieces, lambda p: p.rlike("[:：]"))
    return F.when(fields, F.transform(pieces, normalized)).otherwise(F.array(normalized(text)))


def _sum_of_hashes(pieces: Column, seed: int) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda total, p: F.pmod(total + F.pmod(F.xxhash64(F.lit(seed), p), F.lit(MODULUS)), F.lit(MODULUS)))


def _same_parts(a: Column, b: Column) -> Column:
    """Equality of two multisets by counting, without sorting."""
    counts = F.forall(a, lambda x: F.size(F.filter(a, lambda y: y == x)) == F.size(F.filter(b, lambda y: y == x)))
    return (F.size(a) == F.size(b)) & F.when(F.size(a) == 1, a[0] == b[0]).otherwise(counts)


def _fingerprints(df: DataFrame, scope: str, record_id: str, text: str) -> DataFrame:
    """(scope, record_id, parts, f1, f2); f1 and f2 name the scope and the multiset of parts."""
    rows = df.where(F.col(text).isNotNull() & F.col(record_id).isNotNull()).select(F.col(scope).alias("scope"), F.col(record_id).alias("record_id"), parts(F.col(text)).alias("parts"))
    name = lambda seed: F.xxhash64(F.lit(seed), "scope", F.size("parts"), _sum_of_hashes(F.col("parts"), seed)).alias(f"f{seed}")
    return rows.select("*", name(1), name(2))


def _groups(rows: DataFrame) -> DataFrame:
    """(f1, f2, scope, first_id, last_id, n_rows) of every fingerprint: rows of fixed size, with partial sums before the shuffle."""
    return rows.groupBy("f1", "f2").agg(F.min("scope").alias("scope"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"), F.count(F.lit(1)).alias("n_rows"))


def _compared(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(f1, f2, scope, first_id, record_id, other): rows of groups of several ids; `other` holds parts that differ from the first's."""
    several = groups.where("first_id <> last_id")
    bound = max(HOT_ROWS, (groups.agg(F.sum("n_rows")).first()[0] or 0) // MAX_HOT)
    salts = F.ceil(F.col("n_rows") / bound).cast("int").alias("salts")
    hot = F.broadcast(several.where(F.col("n_rows") > bound).select("f1", "f2", salts))  # at most MAX_HOT rows
    several = several.select("f1", "f2", "first_id", salts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    salted = rows.join(hot, ["f1", "f2"], "left").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    members = salted.join(several, ["f1", "f2", "salt"])
    # as a filter, this would become a join key and shuffle all parts once more
    own = F.filter(F.array(F.struct("scope", "parts")), lambda _: F.col("record_id") == F.col("first_id"))
    firsts = members.select("f1", "f2", "salts", F.explode(own).alias("own")).groupBy("f1", "f2", "salts").agg(F.min("own").alias("first"))
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    met = members.join(firsts, ["f1", "f2", "salt"])
    same = F.col("scope").eqNullSafe(F.col("first.scope")) & _same_parts(F.col("parts"), F.col("first.parts"))
    return met.select("f1", "f2", "scope", "first_id", "record_id", F.when(~same, F.col("parts")).alias("other"))


def _pairs(compared: DataFrame) -> DataFrame:
    """(f1, f2, rest, scope, first_id, record_id) of all records, first ones too; `rest` names groups of other parts than the first's."""
    same = compared.where("other is null").select("f1", "f2", F.lit(None).cast("array<string>").alias("rest"), "scope", "first_id", "record_id")
    rest = compared.where("other is not null").select("f1", "f2", F.array_sort("other").alias("rest"), "scope", "record_id")
    heads = rest.groupBy(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("rest").alias("parts"), F.col("scope").alias("s")).agg(F.min("record_id").alias("first_id"))
    met = rest.join(heads, F.expr("f1 = g1 and f2 = g2 and rest = parts and scope <=> s"))
    return same.unionByName(met.select("f1", "f2", "rest", "scope", "first_id", "record_id"))


def format_duplicates(df: DataFrame, scope: str, record_id: str, text: str) -> DataFrame:
    """(scope, first_id, record_id): every record id that equals a smaller one of its scope, with the smallest of its group.

    Records are compared within a scope (NULL is a scope of its own). NULL texts and NULL ids take no part; texts without
    any letter or digit are equal to each other; rows repeated under one id are one record.
    """
    rows = _fingerprints(df, scope, record_id, text)
    with scratch() as keep:
        compared = keep(materialize(_compared(rows, materialize(_groups(rows)))))
    return _pairs(compared).where("record_id <> first_id").select("scope", "first_id", "record_id").distinct()


def copy_counts(df: DataFrame, scope: str, record_id: str, text: str) -> DataFrame:
    """(scope, first_id, n_records): one row per distinct record of a scope with the number of ids that hold it.

    Records count as equal under the same comparison, parts included, as in format_duplicates.
    """
    rows = _fingerprints(df, scope, record_id, text)
    groups = materialize(_groups(rows))
    pairs = _pairs(materialize(_compared(rows, groups))).groupBy("f1", "f2", "rest", "scope", "first_id", "record_id").agg(F.lit(1).alias("one"))
    counted = pairs.groupBy("f1", "f2", "rest", "scope", "first_id").agg(F.count(F.lit(1)).alias("n_records"))
    alone = groups.where("first_id = last_id").select("scope", "first_id", F.lit(1).cast("long").alias("n_records"))
    return counted.select("scope", "first_id", "n_records").unionByName(alone)
